"""Scalar functions over text and spans, all as column expressions.

Offsets count code points. A span is a struct (label, span_start, span_end), half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<label:string,span_start:bigint,span_end:bigint>"
#: What Python calls white space, as a Java class.
SPACE_CLASS = r"[\s\p{Z}\x1c-\x1f\x85]"
#: Fixed values of the output format: the collapsed label and its mark, and the warning.
REDACTED_LABEL, REDACTED_MARK = "redacted", "<REDACTED>"
MISMATCH = "Input text did not exactly match tokenizer round-trip decode; spans are based on decoded token text."


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_offsets(text: Column, pattern: str, needs: str | None = None) -> Column:
    """All matches of ``pattern``: array of (span_start, span_end).

    The gaps and the matches of a text alternate, so their lengths add up to every offset; Spark's
    position functions count UTF-16 units or find the first match only. The pattern must not match
    the empty string and must mean the same in Java and RE2. ``needs``: a string that every match holds;
    texts without it are passed over before the pattern is tried.
    """
    size = lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = bound(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)), f, size))
    none = F.array().cast("array<struct<span_start:bigint,span_end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    folded = F.aggregate(
        lengths,
        start,
        lambda s, x: F.struct(
            (s["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("span_start"), (s["at"] + x["g"] + x["m"]).alias("span_end")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    there = text.contains(needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(there, folded).otherwise(none)


def label_matches(text: Column, pattern: str, label: str, needs: str | None = None) -> Column:
    """The matches as spans of one label."""
    return F.transform(match_offsets(text, pattern, needs), lambda m: F.struct(F.lit(label).alias("label"), m["span_start"].alias("span_start"), m["span_end"].alias("span_end")))


def surface(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def blocks(text: Column) -> Column:
    """The text in blocks of 1,024 code points (a short one whole): a span's surface is then found without a scan from the text's start."""
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,1024}"), F.lit(0))
    return F.when(F.length(text) > 4096, cut).otherwise(F.array(text))


def piece(held: Column, start: Column, end: Column) -> Column:
    """``surface`` of the text whose ``blocks`` are ``held``; a span before the text's start has none in a long one."""
    first = F.shiftright(start, 10)
    count = F.shiftright(F.greatest(end, start + 1) - 1, 10) - first + 1
    near = F.when(start >= 0, F.array_join(F.slice(held, (first + 1).cast("int"), count.cast("int")), ""))
    return F.when(F.size(held) == 1, surface(F.get(held, F.lit(0)), start, end)).otherwise(surface(near, start - first * 1024, end - first * 1024))


def placeholder(label: Column) -> Column:
    """``<UPPER_SNAKE>``; a label without letters or digits is ``<REDACTED>``."""
    name = F.btrim(F.regexp_replace(F.upper(label), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(name == "", F.lit(REDACTED_MARK)).otherwise(F.concat(F.lit("<"), name, F.lit(">")))


def has_non_ascii(text: Column) -> Column:
    return text.rlike("[^\\x00-\\x7F]")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(f"^{SPACE_CLASS}*$")


def trimmed(held: Column, start: Column, end: Column) -> Column:
    """The span, of the text with the blocks ``held``, without white space at its ends, as (span_start, span_end); empty if nothing is left."""

    def of(body: Column) -> Column:
        head = F.length(F.regexp_extract(body, f"^({SPACE_CLASS}*)", 1)).cast("long")
        tail = F.length(F.regexp_extract(body, f"({SPACE_CLASS}*)$", 1)).cast("long")
        return F.struct((start + head).alias("span_start"), F.greatest(start + head, end - tail).alias("span_end"))

    return bound(piece(held, start, end), of)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null where the bottom isn't positive."""
    return F.when(bottom > 0, top.cast("double") / bottom)


def format_metric(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("-")).otherwise(F.format_string("%.4f", x))


def format_duration(seconds: Column) -> Column:
    whole = F.greatest(F.floor(seconds), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by dotted components; a proper prefix is older; a malformed version compares equal."""
    form = r"^[0-9]+(\.[0-9]+)*$"
    parts = lambda c: F.transform(F.split(c, "\\."), lambda x: x.cast("long"))
    x, y = parts(a), parts(b)
    order = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(a.rlike(form) & b.rlike(form), order).otherwise(0)


def first_mismatch(left: Column, right: Column) -> Column:
    """The first code point where two texts differ, or null."""
    n = F.least(F.length(left), F.length(right))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1))))
    return F.when(left == right, None).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n))


def snippet(text: Column, limit: int) -> Column:
    """The text's start for a preview: everything but printable ASCII as backslash escapes, at most ``limit``
    characters, of which three dots are the last where something was cut."""
    short = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}

    def escaped(c: Column) -> Column:
        code, out = F.ascii(c), F.when(F.lit(False), c)
        for raw, mark in short.items():
            out = out.when(c == raw, F.lit(mark))
        out = out.when((code >= 32) & (code < 127), c).when(code < 256, F.format_string("\\x%02x", code))
        return out.when(code < 65536, F.format_string("\\u%04x", code)).otherwise(F.format_string("\\U%08x", code))

    # An escape is one character at least, so what follows the first limit + 1 can't show.
    places = F.sequence(F.lit(1), F.least(F.length(text), F.lit(limit + 1)))
    whole = F.when(F.length(text) == 0, "").when(text.isNotNull(), F.array_join(F.transform(places, lambda i: escaped(F.substring(text, i, F.lit(1)))), ""))
    cut = lambda w: F.substring(w, 1, limit) if limit <= 3 else F.concat(F.substring(w, 1, limit - 3), F.lit("..."))
    return bound(whole, lambda w: F.when(F.length(w) <= limit, w).otherwise(cut(w)))


def highlight(text: Column, spans: Column, palette: list[str], reset: str = "\x1b[0m") -> Column:
    """Terminal colours around disjoint, sorted spans: the palette repeats by the order of the labels."""
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    colours = F.array(*[F.lit(c) for c in palette])
    paint = lambda s: F.concat(F.get(colours, F.pmod(F.array_position(labels, s["label"]).cast("int") - 1, F.lit(len(palette)))), surface(text, s["span_start"], s["span_end"]), F.lit(reset))
    return splice(text, spans, paint)


def splice(text: Column, spans: Column, mark) -> Column:
    """``text`` with each of the disjoint, sorted spans replaced by ``mark(span)`` (``<REDACTED>`` where that is null).
    Linear: the pieces between spans are cut from blocks and joined once."""

    def of(held: Column, all_: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(all_, i)["span_end"], F.lit(0).cast("long"))
        made = F.transform(all_, lambda x, i: F.concat(piece(held, stop(i - 1), x["span_start"]), F.coalesce(mark(x), F.lit(REDACTED_MARK))))
        rest = piece(held, stop(F.size(all_) - 1), F.length(text).cast("long"))
        return F.array_join(F.concat(made, F.array(rest)), "")

    return F.when(text.isNotNull(), bound(blocks(text), lambda held: bound(spans, lambda all_: of(held, all_))))
