"""Redaction: detectors to spans, spans to placeholders, summaries and result rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import text as T
from veilspan.operators import spans as S

#: Fixed values of the output format.
SCHEMA_VERSION = 1
MODES = ("typed", "redacted")

#: (label, pattern); patterns mean the same in Java and RE2 and match no empty text.
Rule = tuple[str, str]
PRIMARY: tuple[Rule, ...] = (
    ("account_number", "[0-9]{16}"),
    ("private_email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("private_phone", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("private_url", r"https?://[^\x00-\x20\x22'<>]+"),
    ("secret", "token = \"[0-9a-f]{40}\""),
)
#: Narrower, wider and mistaken on purpose: predictions for evaluation without a model.
ALTERNATE: tuple[Rule, ...] = (
    ("account_number", "[0-9]{12,}"),
    ("account_number", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("private_email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+"),
    ("private_phone", r"[^ ]+ \+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("secret", "[0-9a-f]{40}"),
)


#: What every match of a pattern holds.
NEEDS = {
    PRIMARY[1][1]: "@",
    PRIMARY[2][1]: "+",
    PRIMARY[3][1]: "://",
    PRIMARY[4][1]: 'token = "',
    ALTERNATE[2][1]: "@",
    ALTERNATE[3][1]: " +",
}


def detect(text: Column, rules: Sequence[Rule] = PRIMARY) -> Column:
    """All matches of all rules, by rule and then by place."""
    return F.concat(*[T.label_matches(text, p, label, NEEDS.get(p)) for label, p in rules])


def output_mode(spans: Column, mode: str) -> Column:
    """Spans with surface-independent placeholders, typed or collapsed."""
    if mode not in MODES:
        raise ValueError(f"the output mode is one of {MODES}")
    if mode == "typed":
        label, mark = (lambda s: s["label"]), (lambda s: T.placeholder(s["label"]))
    else:
        label, mark = (lambda s: F.lit(T.REDACTED_LABEL)), (lambda s: F.lit(T.REDACTED_MARK))
    return F.transform(spans, lambda s: F.struct(label(s).alias("label"), s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), mark(s).alias("placeholder")))


def redacted(text: Column, detected: Column) -> Column:
    return T.splice(text, detected, lambda s: s["placeholder"])


def by_label(detected: Column) -> Column:
    """Counts by label, labels in order: map<string,bigint>."""
    labels = F.transform(detected, lambda s: s["label"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(x, F.size(F.filter(labels, lambda y: y == x)).cast("long"))))


@dataclass(frozen=True)
class Redactor:
    """Immutable options; ``with_*`` returns a changed copy, ``transform`` adds the result columns."""

    rules: tuple[Rule, ...] = PRIMARY
    mode: str = "typed"
    trim_whitespace: bool = True
    discard_overlaps_by_label: bool = False
    text_only: bool = False

    def with_rules(self, rules: Sequence[Rule]) -> Redactor:
        return replace(self, rules=tuple(rules))

    def with_mode(self, mode: str) -> Redactor:
        if mode not in MODES:
            raise ValueError(f"the output mode is one of {MODES}")
        return replace(self, mode=mode)

    def with_trimming(self, on: bool) -> Redactor:
        return replace(self, trim_whitespace=on)

    def with_text_only(self, on: bool) -> Redactor:
        return replace(self, text_only=on)

    def spans(self, text: Column, found: Column | None = None) -> Column:
        """Disjoint spans, from ``found`` (another detector's) or from the rules."""
        spans = detect(text, self.rules) if found is None else found
        if self.trim_whitespace:
            spans = S.trim_spans(text, spans)
        if self.discard_overlaps_by_label:
            spans = S.discard_overlaps_by_label(spans)
        return S.select_non_overlapping(S.in_bounds(text, spans))

    def transform(self, df: DataFrame, text: str = "text", spans: str | None = None, decoded: str | None = None) -> DataFrame:
        """Adds detected_spans, redacted_text and span_count; ``decoded`` names a column with the text that
        the spans refer to, if a tokenizer's round trip may have changed it."""
        source = F.col(decoded) if decoded else F.col(text)
        body = F.coalesce(source, F.lit(""))
        out = df.withColumn("detected_spans", output_mode(self.spans(body, F.col(spans) if spans else None), self.mode))
        out = out.withColumn("redacted_text", F.when(source.isNotNull(), redacted(body, F.col("detected_spans"))))
        if self.text_only:
            return out.drop("detected_spans")
        mismatch = ~F.col(decoded).eqNullSafe(F.col(text)) if decoded else F.lit(False)
        return out.withColumn("span_count", F.size("detected_spans").cast("long")).withColumn("decoded_mismatch", mismatch)

    def results(self, df: DataFrame, text: str = "text", **options) -> DataFrame:
        """One JSON result per row in the column ``result``; the warning is there only if it applies."""
        out = self.with_text_only(False).transform(df, text, **options)
        summary = F.struct(F.lit(self.mode).alias("output_mode"), "span_count", by_label(F.col("detected_spans")).alias("by_label"), "decoded_mismatch")
        shown = lambda held, s: T.piece(held, s["span_start"], s["span_end"])
        found = T.bound(
            T.blocks(F.col(text)),
            lambda held: F.transform(
                "detected_spans", lambda s: F.struct(s["label"].alias("label"), s["span_start"].cast("int").alias("start"), s["span_end"].cast("int").alias("end"), shown(held, s).alias("text"), s["placeholder"].alias("placeholder"))
            ),
        )
        body = F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), summary.alias("summary"), F.col(text).alias("text"), found.alias("detected_spans"), "redacted_text", F.when(F.col("decoded_mismatch"), F.lit(T.MISMATCH)).alias("warning")
        )
        return out.withColumn("result", F.to_json(body))


def redact(df: DataFrame, text: str = "text", mode: str = "typed") -> DataFrame:
    """With the default options."""
    return Redactor(mode=mode).transform(df, text)


def spans_long(df: DataFrame, key: str, spans: Column, text: Column | None = None) -> DataFrame:
    """One row per span: key, label, span_start, span_end and, with ``text``, its surface."""
    if text is not None:  # surfaces within the row: no copy of the text per span
        bare = spans
        spans = T.bound(T.blocks(text), lambda held: F.transform(bare, lambda s: s.withField("surface", T.piece(held, s["span_start"], s["span_end"]))))
    return df.select(key, F.explode(spans).alias("s")).select(key, "s.*")


def paragraph_hits(df: DataFrame, key: str, text: Column, spans: Column) -> DataFrame:
    """key, paragraph (from 0), surface: each distinct surface of the row's spans with each line that contains it,
    whether or not the span lies there; what a paragraph-wise redaction has to replace."""
    surfaces = T.bound(T.blocks(text), lambda held: F.array_distinct(F.transform(spans, lambda s: T.piece(held, s["span_start"], s["span_end"]))))
    one = df.select(key, text.alias("_text"), surfaces.alias("_found")).where(F.size("_found") > 0)
    lines = one.select(key, "_found", F.posexplode(F.split("_text", "\n", -1)).alias("paragraph", "_line"))
    hits = F.filter("_found", lambda x: (x != "") & F.col("_line").contains(x))
    return lines.select(key, F.col("paragraph").cast("long").alias("paragraph"), F.explode(hits).alias("surface"))
