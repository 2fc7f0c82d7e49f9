"""The same row-local redaction over streams: nothing is kept between rows, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.functions import text as T
from veilspan.operators.redact import Redactor


def read_lines(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Lines of files as they arrive; blank ones go."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.regexp_replace("value", "[\r\n]+$", "").alias("text")).where(~T.is_blank(F.col("text")))


def redacted(stream: DataFrame, redactor: Redactor | None = None, text: str = "text") -> DataFrame:
    return (redactor or Redactor()).transform(stream, text)


def write_results(stream: DataFrame, path: str, checkpoint: str, redactor: Redactor | None = None) -> StreamingQuery:
    """JSON results, exactly once by the file sink's log."""
    out = (redactor or Redactor()).results(stream).select(F.col("result").alias("value"))
    return out.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def label_rates(stream: DataFrame, time: str, text: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Found labels by event-time window (an extension; the batch engine has no time)."""
    found = Redactor().transform(stream, text).select(F.col(time).alias("_t"), F.explode("detected_spans").alias("s"))
    return found.withWatermark("_t", late).groupBy(F.window("_t", window), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
