"""Writers: predictions, metrics and results as JSON lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import text as T


def grouped_spans(text: Column, spans: Column) -> Column:
    """map<"label: surface", [[start, end], …]> in order of first occurrence."""
    name = lambda held, s: F.concat(s["label"], F.lit(": "), T.piece(held, s["span_start"], s["span_end"]))
    keyed = T.bound(T.blocks(text), lambda held: F.transform(spans, lambda s: F.struct(name(held, s).alias("k"), F.array(s["span_start"], s["span_end"]).alias("o"))))
    keys = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(keyed, lambda x: x["k"] == k), lambda x: x["o"]))))


def predictions(df: DataFrame, spans: str, example_id: str = "example_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """example_id, text, predicted_spans and any of ``extra`` that aren't null."""
    return df.select(F.col(example_id).alias("example_id"), F.col(text).alias("text"), grouped_spans(F.col(text), F.col(spans)).alias("predicted_spans"), *(extra or []))


def write_predictions(df: DataFrame, path: str, spans: str, **options) -> None:
    predictions(df, spans, **options).write.mode("errorifexists").json(path)


def write_metrics(metrics: DataFrame, path: str, config: dict | None = None, args: dict | None = None) -> None:
    """One sorted JSON object; metrics are a few hundred rows at most, one per label and measure."""
    rows = {r["metric"]: r["value"] for r in metrics.collect()}
    summary = {k: v for k, v in rows.items() if not k.startswith("by_class.")}
    Path(path).write_text(json.dumps({"summary": summary, "metrics": rows, "config": config or {}, "args": args or {}}, sort_keys=True, indent=2), encoding="utf-8")
