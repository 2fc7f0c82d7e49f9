"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate, symbols); failed lines are
removed; a document that loses too much of its text, or fails the base rules, is rejected. All work
is row-local: no exchange, whatever the size of the table or the skew of any key.

Defined cases: a null text counts as a text without words; ties and repeated rows are judged row by
row; an empty table gives an empty result; other columns pass through, and a column that clashes
with a result column is replaced by it. Hash equality of 64 bits stands for equality of 5-word windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.store import unused

#: The words' separators and the counted symbols.
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    r"(?i)javascript|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|"
    r"sign (up|in)|log ?in|subscribe|share this|read more|lorem ipsum"
)
RESULT = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
    "n_lines n_failed_lines kept_chars cleaned_text"
).split()


def _line_fails(line: Column, max_boilerplate_words: int) -> Column:
    bare = F.regexp_replace(line, f"{SPACE}+", "")
    chars = F.length(bare)
    words = F.regexp_count(line, F.lit(f"{NO_SPACE}+"))
    navigation = (F.regexp_count(line, F.lit("[|»›]")) >= 2) & (F.regexp_count(line, F.lit("[|»›]")) * 4 >= words)
    symbols = F.regexp_count(line, F.lit("[#*$%&<>]")) * 10 > chars
    shouting = F.regexp_count(line, F.lit(r"[!?]{2,}")) * 3 > words
    unpunctuated = (words >= 8) & ~line.rlike(r"[.!?…。:;](?:[\"'”»)\]]*)(?:[\x20\x09-\x0D]|$)")
    boilerplate = (words <= max_boilerplate_words) & line.rlike(BOILERPLATE)
    return (words > 0) & (navigation | symbols | shouting | unpunctuated | boilerplate)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def judge(
    docs: DataFrame,
    text: str = "text",
    window: int = 5,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_kept_percent: int = 50,
    max_boilerplate_words: int = 12,
) -> DataFrame:
    """``docs`` with counts, verdicts and the cleaned text (null where the text is null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c.lower() not in RESULT]
    words, lines, good, clean, hashes, repeated = unused(docs.columns, "words", "lines", "good", "clean", "windows", "repeats")
    zero = F.lit(0).cast("long")
    longs = lambda c: F.coalesce(c.cast("long"), zero)

    one = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.transform(F.filter(F.split(body, f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias(words),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(NO_SPACE)).alias(lines),
        F.filter(F.split(body, "\n"), lambda x: ~_line_fails(x, max_boilerplate_words)).alias(good),
        longs(F.length(F.regexp_replace(body, f"{SPACE}+", ""))).alias("word_chars"),
        longs(F.regexp_count(body, F.lit(SYMBOLS))).alias("n_symbols"),
    )
    wins = F.when(
        F.size(words) >= window,
        F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        "*",
        longs(F.size(words)).alias("n_words"),
        longs(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.array_join(good, "\n").alias(clean),
        longs(F.size(lines)).alias("n_lines"),
        wins.alias(hashes),
    ).drop(lines, words)
    # Most texts repeat no window: one cheap sort tells, and only the others look for positions.
    repeats = _bind(F.sort_array(hashes), lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: F.get(s, i) == F.get(s, i - 1)))
    three = two.withColumn(repeated, F.coalesce(repeats, F.lit(False)))
    placed = F.when(F.col(repeated), F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    same = lambda s: lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
    at = _bind(placed, lambda s: F.sort_array(F.transform(F.filter(s, same(s)), lambda e: e["p"])))
    covered = _bind(
        at,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )
    four = three.withColumn("n_repeat_words", F.when(F.col(repeated), longs(covered)).otherwise(zero)).drop(hashes, repeated)
    kept_chars = longs(F.length(F.regexp_replace(clean, f"{SPACE}+", "")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    # Always true, but not deterministic: a filter on ``kept`` must not be pushed below, where every
    # reference would be replaced by its whole expression, again and again.
    here = F.spark_partition_id() >= 0
    return four.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (kept_chars * 100 >= F.col("word_chars") * min_kept_percent) & here).alias("kept"),
        "n_lines",
        (F.col("n_lines") - F.size(F.filter(good, lambda x: x.rlike(NO_SPACE)))).alias("n_failed_lines"),
        kept_chars.alias("kept_chars"),
        F.when(F.col(text).isNotNull(), F.col(clean)).alias("cleaned_text") if text in keep else F.col(clean).alias("cleaned_text"),
    )
