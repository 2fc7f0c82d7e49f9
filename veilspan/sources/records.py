"""Labelled records, plain texts and transcripts as DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import text as T

#: Never inferred: the keys of ``spans`` are data. A boolean or fraction as an offset fails the read.
RECORD = "text string, spans map<string,array<array<bigint>>>, label array<struct<category:string,start:bigint,end:bigint>>, info map<string,string>"
#: Fixed value: where a message begins in a transcript; a system turn is no marker.
MESSAGE = "(?:^|\n\n)(?:user|assistant): "
SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".csv", ".json", ".log")


#: Where a record stands: files by name, in a file by its parts, in a part by lines.
PLACE = ("_file", "_part", "_line")


def read_records(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """JSON lines (also gzip), one object per line, blank lines skipped, anything else fails. Remote or
    local: Spark's own path rules, globs included. ``placed`` adds the columns of ``PLACE``, by which ``numbered``
    gives the records' positions."""
    found = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    if not placed:
        return found
    return found.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_line"))


def numbered(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """``index`` (from 0) in the order of the named columns; ranks by range-partitioned parts, not in one task. Their
    number is fixed, so both jobs see the same parts."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    marked = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    first = marked.groupBy("_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    parts = sorted(first.collect())  # one per partition
    at, rows = 0, []
    for r in parts:
        rows.append((r["_p"], r["_first"], at))
        at += r["_n"]
    base = records.sparkSession.createDataFrame(rows, "_p int, _first long, _base long")
    return marked.join(F.broadcast(base), "_p").withColumn("index", F.col("_i") - F.col("_first") + F.col("_base")).drop("_p", "_i", "_first", "_base")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts (path, text); empty ones skipped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where("text <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text per line that isn't blank; line ends go."""
    return spark.read.text(path).select(F.regexp_replace("value", "[\r\n]+$", "").alias("text")).where(~T.is_blank(F.col("text")))


def read_uploads(spark: SparkSession, path: str, suffixes: Sequence[str] = (".txt", ".md", ".csv", ".json", ".log")) -> DataFrame:
    """Files of the allowed suffixes as texts; invalid UTF-8 becomes replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(allowed(F.col("path"), suffixes)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def allowed(path: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*suffixes)


def gold_spans(records: DataFrame, key: str = "example_id") -> DataFrame:
    """key, label, span_start, span_end, place. ``spans`` (if it has entries) before ``label``; the label is
    the key before its first ": "."""
    none = "array<struct<label:string,span_start:bigint,span_end:bigint>>"
    spans = F.flatten(
        F.transform(F.map_entries("spans"), lambda e: F.transform(e["value"], lambda o: F.struct(F.substring_index(e["key"], ": ", 1).alias("label"), F.get(o, F.lit(0)).alias("span_start"), F.get(o, F.lit(1)).alias("span_end"))))
    ).cast(none)
    label = F.transform("label", lambda x: F.struct(x["category"].alias("label"), x["start"].alias("span_start"), x["end"].alias("span_end"))).cast(none)
    chosen = F.when(F.size(F.coalesce(F.map_keys("spans"), F.array())) > 0, spans).otherwise(F.coalesce(label, F.array().cast(none)))
    return records.select(key, F.posexplode(chosen).alias("place", "s")).select(key, "s.*", "place")


def validated(spans: DataFrame, texts: DataFrame, labels: Sequence[str] | None = None, key: str = "example_id") -> DataFrame:
    """``spans``, failing the query on a bad bound (0 <= start <= end <= length) or, with ``labels``, an unknown label."""
    rows = spans.join(texts.select(key, F.length("text").cast("long").alias("_n")), key)
    ok = (F.col("span_start") >= 0) & (F.col("span_start") <= F.col("span_end")) & (F.col("span_end") <= F.col("_n"))
    bad = F.raise_error(F.concat(F.lit("span out of bounds: "), F.to_json(F.struct(key, "label", "span_start", "span_end")))).cast("string")
    label = F.when(F.coalesce(ok, F.lit(False)), F.col("label")).otherwise(bad)
    if labels is not None:
        label = F.when(F.col("label").isin(*labels), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("string"))
    return rows.withColumn("label", label).drop("_n")


def unique_ids(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``df``, failing the query if a key is null or repeats."""
    told = F.raise_error(F.concat(F.lit(f"{key} is missing or repeats: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    counted = df.groupBy(key).agg(F.count("*").alias("_n"))
    checked = counted.select(F.when((F.col("_n") == 1) & F.col(key).isNotNull(), F.col(key)).otherwise(told.cast(df.schema[key].dataType)).alias("_key"))
    return df.join(checked, df[key] == checked["_key"], "left_semi")


def untyped(spans: DataFrame, label: str) -> DataFrame:
    """Every span under one label, the original kept beside it."""
    return spans.withColumn("original_label", F.col("label")).withColumn("label", F.lit(label))


def explode_messages(records: DataFrame, key: str) -> DataFrame:
    """One row per message: key, message_index, text, and the record's spans that lie inside, moved.

    A message runs from the end of its marker to the next marker; text before the first marker goes; a
    record without a marker is one message; empty messages go. Records of the ``label`` form are refused,
    since their offsets would point into the transcript."""
    marks = T.match_offsets(F.col("text"), MESSAGE)
    n = F.length("text").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), n.alias("e")))
    cut = F.transform(F.col("_m"), lambda m, i: F.struct(m["span_end"].alias("a"), F.coalesce(F.get(F.col("_m"), i + 1)["span_start"], n).alias("e")))
    bodies = F.filter(F.when(F.size("_m") > 0, cut).otherwise(whole), lambda b: b["e"] > b["a"])
    if "label" in records.columns:
        refused = F.raise_error(F.lit("message records need spans, not label")).cast("string")
        records = records.withColumn("text", F.when(F.size(F.coalesce("label", F.array().cast(records.schema["label"].dataType))) > 0, refused).otherwise(F.col("text"))).drop("label")
    rest = [c for c in records.columns if c not in (key, "text", "spans")]
    rows = records.withColumn("_m", marks).select(key, *rest, "text", *(["spans"] if "spans" in records.columns else []), F.posexplode(bodies).alias("message_index", "_b"))
    out = rows.withColumn("message_index", F.col("message_index").cast("long"))
    if "spans" in records.columns:
        inside = lambda o: (F.get(o, F.lit(0)) >= F.col("_b.a")) & (F.get(o, F.lit(1)) <= F.col("_b.e"))
        moved = F.transform_values("spans", lambda k, v: F.transform(F.filter(v, lambda o: (F.size(o) == 2) & inside(o)), lambda o: F.transform(o, lambda x: x - F.col("_b.a"))))
        out = out.withColumn("spans", F.map_filter(moved, lambda k, v: F.size(v) > 0))
    if "info" in rest:
        out = out.withColumn("info", F.map_concat(F.coalesce("info", F.create_map().cast("map<string,string>")), F.create_map(F.lit("message_index"), F.col("message_index").cast("string"))))
    return out.withColumn("text", T.surface(F.col("text"), F.col("_b.a"), F.col("_b.e"))).drop("_b")


def stable_id(text: Column, index: Column) -> Column:
    """The hash of {"index", "text"} as Python's JSON writes it; for records without labels."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("text"))), r'(?s)^\{"text":(.*)\}$', 1)
    return F.sha2(F.concat(F.lit('{"index": '), index.cast("string"), F.lit(', "text": '), quoted, F.lit("}")), 256)


def stable_ids(records: DataFrame, index: str = "index") -> DataFrame:
    """``records`` with example_id, labels included; canonical JSON needs Python, in Arrow batches."""
    @F.pandas_udf("string")
    def digest(frame: pd.DataFrame) -> pd.Series:
        out = []
        for text, i, spans, label in zip(frame["text"], frame["index"], frame["spans"], frame["label"], strict=True):
            body = {"text": text or "", "index": int(i)}
            if spans is not None:
                body["spans"] = json.loads(spans)
            if label is not None:
                body["label"] = json.loads(label)
            out.append(hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest())
        return pd.Series(out)

    packed = F.struct("text", F.col(index).alias("index"), F.to_json("spans").alias("spans"), F.to_json("label").alias("label"))
    return records.withColumn("example_id", digest(packed))
