"""Token files: whole texts to ids, written as checksummed containers of coded blocks in document order.

The table is range-partitioned by document id (ties are spread by a hash of the text and then by where the
row was read, so repeated ids and whole repeated rows don't gather in one task) and sorted within partitions
(``partitions`` of them, or as many as ``spark.sql.shuffle.partitions`` and adaptive execution give); every task writes containers of whole
documents in that order, as rows of Parquet files, whose writer commits a task's files only once. A
container row has the documents' ids and lengths and one ``range_coder`` payload. Reading decodes each
container by itself; only one total per partition, never per document, goes through the driver.

Defined cases: a null or empty text has its end token alone; repeated rows are documents of their
own; documents without an id come first; an empty table gives no container; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import range_coder
from veilspan.llm.store import shared_dir, small_batches, trim
from veilspan.llm.tokens import encoder

CONTAINERS = (
    "part long, part_start long, doc_ids array<long>, n_tokens array<long>, payload binary"
)
_SCHEMA = pa.schema(
    [("part", pa.int64()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())]
)
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = 4 << 20,
    container_ids: int = 3 << 20,
    partitions: int | None = None,
) -> None:
    """Write the files under ``path`` (any store that Spark writes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(2, "little")
        docs_, held, size = [], [], 0

        def container() -> pa.RecordBatch:
            nonlocal start, size
            ids = np.frombuffer(b"".join(held), "<u2")
            cols = [[part], [start], [list(docs_)], [[len(x) // 2 for x in held]], [range_coder.encode(ids, block)]]
            start += len(ids)
            docs_.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                for d, ids in zip(rows.column(0).to_pylist(), enc.batch(rows.column(1).to_pylist()), strict=True):
                    docs_.append(d)
                    held.append(ids + end)
                    size += len(ids) // 2 + 1
                    if size >= container_ids:
                        yield container()
        if held:
            yield container()
        trim()

    chosen = small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text"), "spread"]
    spread = chosen.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    ordered = spread.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions("doc_id", "text", "spread").drop("spread")
    ordered.mapInArrow(task, CONTAINERS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Containers, each with the number of ids before it."""
    files = spark.read.schema(CONTAINERS).parquet(path)
    totals = files.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    rows = sorted(totals.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one per partition of the writer
    starts, at = [], 0
    for r in rows:
        starts.append((r["part"], at))
        at += r["n"]
    starts = spark.createDataFrame(starts, "part long, before long")
    return files.join(F.broadcast(starts), "part").select("doc_ids", "n_tokens", (F.col("before") + F.col("part_start")).alias("start"), "payload")


def digests(containers: DataFrame) -> DataFrame:
    """Decode all containers: one row per document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = range_coder.decode(row.column("payload")[0].as_buffer().to_pybytes())
                counts = np.array(row.column("n_tokens")[0].as_py(), dtype=np.int64)
                stops = np.cumsum(counts)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids")[0].values, pa.array(stops - counts + row.column("start")[0].as_py()), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return containers.mapInArrow(task, DIGESTS)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to a new folder in the shared store, read back, and digest."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/veilspan-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, **options)
    return digests(read(spark, path))
