"""From raw documents to packed sequences: toxicity, quality, near copies, benchmark passages, packing.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontamination, ngram_join, packing, quality_rules, toxicity
from veilspan.llm.queries import TOXIC_FROM, tokenizer_path, toxicity_model
from veilspan.llm.store import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. The examples come from the labelled rows of the raw table."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir), TOXIC_FROM)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, the lines that failed go."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # no column clashes with a result
    judged = quality_rules.judge(whole).where("kept")
    changed = {"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text")}
    return judged.select(*[changed.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return ngram_join.keep_first(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontamination.drop_contaminated(docs, decontamination.build(docs, table(spark, sf_dir, "benchmark")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack_windows),
]

#: Nearest-example scores, latent retrieval and tokenisation have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/veilspan-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
