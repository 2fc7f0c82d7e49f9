"""Span algebra: greedy selections, trimming, tag islands, conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import text as T


def _greedy(ordered: Column) -> Column:
    """Left to right over sorted (…, label, span_start, span_end): keep what starts at or after the last kept end."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{T.SPAN}>").alias("kept"))
    fits = lambda s, x: (x["span_start"] >= s["at"]) & (x["span_end"] > x["span_start"])
    span = lambda x: F.struct(x["label"].alias("label"), x["span_start"].alias("span_start"), x["span_end"].alias("span_end"))
    return F.aggregate(
        ordered,
        start,
        lambda s, x: F.when(fits(s, x), F.struct(x["span_end"].alias("at"), F.concat(s["kept"], F.array(span(x))).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def _ordered(spans: Column, *, ties: str) -> Column:
    """By start, then longest first, then by ``label`` or input order."""
    key = lambda x, i: F.struct(
        x["span_start"].alias("span_start"),
        (x["span_start"] - x["span_end"]).alias("shorter"),
        (x["label"] if ties == "label" else F.lit("")).alias("tie"),
        i.alias("place"),
        x["label"].alias("label"),
        x["span_end"].alias("span_end"),
    )
    return F.array_sort(F.transform(spans, key))


def select_non_overlapping(spans: Column) -> Column:
    """The left-to-right choice across labels: earliest start, longest, then smallest label."""
    return _greedy(_ordered(spans, ties="label"))


def discard_overlaps_stable(spans: Column) -> Column:
    """The same across labels, ties by input order; empty spans stay unless they start before a kept end."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{T.SPAN}>").alias("kept"))
    span = lambda x: F.struct(x["label"].alias("label"), x["span_start"].alias("span_start"), x["span_end"].alias("span_end"))
    return F.aggregate(
        _ordered(spans, ties="order"),
        start,
        lambda s, x: F.when(x["span_start"] >= s["at"], F.struct(x["span_end"].alias("at"), F.concat(s["kept"], F.array(span(x))).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def discard_overlaps_by_label(spans: Column) -> Column:
    """The greedy choice within each label; the result is sorted by start, end, label."""

    def by_label(all_: Column) -> Column:
        labels = F.array_distinct(F.transform(all_, lambda s: s["label"]))
        return F.flatten(F.transform(labels, lambda one: _greedy(_ordered(F.filter(all_, lambda s: s["label"] == one), ties="label"))))

    kept = T.bound(spans, by_label)
    sort = F.array_sort(F.transform(kept, lambda s: F.struct(s["span_start"].alias("a"), s["span_end"].alias("b"), s["label"].alias("c"))))
    return F.transform(sort, lambda s: F.struct(s["c"].alias("label"), s["a"].alias("span_start"), s["b"].alias("span_end")))


def trim_spans(text: Column, spans: Column) -> Column:
    """Spans without white space at their ends; emptied ones go."""
    cut = T.bound(T.blocks(text), lambda held: F.transform(spans, lambda s: F.struct(s["label"].alias("label"), T.trimmed(held, s["span_start"], s["span_end"]).alias("p"))))
    out = F.transform(cut, lambda s: F.struct(s["label"].alias("label"), s["p"]["span_start"].alias("span_start"), s["p"]["span_end"].alias("span_end")))
    return F.filter(out, lambda s: s["span_end"] > s["span_start"])


def in_bounds(text: Column, spans: Column) -> Column:
    """0 <= start < end <= length."""
    return F.filter(spans, lambda s: (s["span_start"] >= 0) & (s["span_start"] < s["span_end"]) & (s["span_end"] <= F.length(text)))


def normalised(spans: Column, count: Column) -> Column:
    """Spans clamped to 0 and ``count``, without the emptied ones, by start, end and label."""
    clamp = lambda s: F.struct(F.greatest(s["span_start"], F.lit(0).cast("long")).alias("a"), F.least(s["span_end"], count).alias("b"), s["label"].alias("c"))
    sort = F.array_sort(F.filter(F.transform(spans, clamp), lambda s: s["b"] > s["a"]))
    return F.transform(sort, lambda s: F.struct(s["c"].alias("label"), s["a"].alias("span_start"), s["b"].alias("span_end")))


def clipped(spans: Column, length: Column) -> Column:
    """What of the spans lies in a preview of so many characters, in the same order."""
    shorter = F.transform(spans, lambda s: F.struct(s["label"].alias("label"), s["span_start"].alias("span_start"), F.least(s["span_end"], length).alias("span_end")))
    return F.filter(shorter, lambda s: s["span_end"] > s["span_start"])


def matched_within(spans: Column, others: Column, typed: bool = True, keep: bool = True) -> Column:
    """Of one row's spans those inside one of its others, or, without ``keep``, those inside none."""

    def inside(x: Column, o: Column) -> Column:
        held = (o["span_start"] <= x["span_start"]) & (o["span_end"] >= x["span_end"])
        return held & (o["label"] == x["label"]) if typed else held

    hit = lambda all_, x: F.coalesce(F.exists(all_, lambda o: inside(x, o)), F.lit(False))
    return T.bound(others, lambda all_: F.filter(spans, lambda x: hit(all_, x) if keep else ~hit(all_, x)))


def tags_to_spans(tokens: DataFrame, *, key: str = "doc_id", index: str = "token_idx", boundary: str = "boundary", label: str = "label") -> DataFrame:
    """Token spans (key, label, token_start, token_end) of tags, tolerant of broken sequences.

    An island begins at B or S, and at an I or E that doesn't continue an adjacent B or I of the same
    label. Rows without a label (unknown ids) must be left out before; background rows close by their gap.
    """
    w = Window.partitionBy(key).orderBy(index)
    prev = lambda c: F.lag(c).over(w)
    follows = F.coalesce((prev(index) == F.col(index) - 1) & prev(boundary).isin("B", "I") & (prev(label) == F.col(label)), F.lit(False))
    marked = tokens.withColumn("_new", (F.col(boundary).isin("B", "S") | ~follows).cast("int")).where(F.col(boundary).isNotNull())
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island", label).agg(F.min(index).cast("long").alias("token_start"), (F.max(index) + 1).cast("long").alias("token_end")).select(key, label, "token_start", "token_end")


def token_to_char_spans(spans: DataFrame, tokens: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Token spans to code-point spans through two equi-joins; invalid and empty ones go."""
    first = tokens.select(key, F.col("token_idx").alias("token_start"), F.col("char_start").alias("span_start"))
    last = tokens.select(key, (F.col("token_idx") + 1).alias("token_end"), F.col("char_end").alias("span_end"))
    return spans.join(first, [key, "token_start"]).join(last, [key, "token_end"]).where("span_start < span_end").select(key, "label", "span_start", "span_end")


def bioes(position: Column, count: Column) -> Column:
    """The boundary of the token at ``position`` (from 1) of ``count`` tokens."""
    return F.when(count == 1, "S").when(position == 1, "B").when(position == count, "E").otherwise("I")
