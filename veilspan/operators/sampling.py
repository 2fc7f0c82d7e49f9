"""Seeded splits and batches by rank of a hash.

Ranks come without a global sort in one task: the hash's leading digits make buckets, whose sizes are
summed up first, and rows are ranked within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(seed: int, key: str) -> Column:
    """Of seed and key; null keys have a hash of their own."""
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), F.lit(f"{seed}")).cast("binary"))


def seeded_rank(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """``df`` with ``_rank`` (from 1, by the md5 of seed and key) and ``_n``, the number of rows."""
    marked = df.withColumn("_h", _hash(seed, key)).withColumn("_b", F.left("_h", F.lit(3)))
    sizes = marked.groupBy("_b").agg(F.count("*").alias("_m"))  # at most 4,096 buckets
    w = Window.orderBy("_b")
    before = sizes.select("_b", (F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_before"), F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return marked.withColumn("_r", within).join(F.broadcast(before), "_b").withColumn("_rank", F.col("_before") + F.col("_r")).drop("_h", "_b", "_r", "_before")


def first_examples(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by key: for trial runs. Each task keeps its own first ``n`` only."""
    if n < 0:
        raise ValueError("a number of examples is not negative")
    return df.orderBy(key).limit(n)


def split_validation(df: DataFrame, share: float, seed: int, key: str = "doc_id") -> DataFrame:
    """``validation`` is true for exactly floor(n * share) rows, at least 1 and at most n - 1; none if the
    share is 0 or there are fewer than two rows."""
    size = F.least(F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1).cast("long")), F.col("_n") - 1)
    pick = F.col("_rank") <= size if share > 0 else F.lit(False)
    return seeded_rank(df, seed, key).withColumn("validation", (F.col("_n") > 1) & pick).drop("_rank", "_n")


def shuffled_batches(df: DataFrame, size: int, seed: int, key: str = "doc_id") -> DataFrame:
    return seeded_rank(df, seed, key).withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank", "_n")
