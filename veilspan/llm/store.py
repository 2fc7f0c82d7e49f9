"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, behind a prefix that none of ``columns`` begins with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return [prefix + n for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests on one machine) a folder of our own, which
    is refused on a cluster, whose machines can't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="veilspan-")
        spark.sparkContext.setCheckpointDir(_own[key])
    return _own[key]


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: lineage ends there, and lost
    executors cost a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspan-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after making sure that Arrow batches of whole texts stay small: Spark's default of 10,000
    rows is for narrow rows. A value that the session sets itself is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def forget(held: Broadcast) -> None:
    """Drop a Python worker's copy of a broadcast value, which it would keep after its task; whoever asks next loads it
    anew. Without effect where the copy is held under another name."""
    held.__dict__.pop("_value", None)


def trim() -> None:
    """Give a Python worker's free memory back: it outlives its task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
