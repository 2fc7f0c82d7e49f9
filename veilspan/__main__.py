"""``python -m veilspan redact|eval``: the engine's commands, also for spark-submit."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspan.operators import metrics, redact, spans
from veilspan.sources import records, sinks


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="veilspan")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("redact", help="texts, or lines or whole files of a path, to JSON results")
    r.add_argument("texts", nargs="*")
    r.add_argument("--input")
    r.add_argument("--whole-files", action="store_true")
    r.add_argument("--output")
    r.add_argument("--output-mode", choices=redact.MODES, default="typed")
    r.add_argument("--no-trim-whitespace", action="store_true")
    r.add_argument("--text-only", action="store_true")
    e = sub.add_parser("eval", help="span metrics of the rules against labelled records")
    e.add_argument("dataset")
    e.add_argument("--eval-mode", choices=("typed", "untyped"), default="typed")
    e.add_argument("--dataset-variant", choices=("full", "message"), default="full")
    e.add_argument("--skip-non-ascii-examples", action="store_true")
    e.add_argument("--metrics")
    e.add_argument("--predictions")
    if argv and argv[0] not in ("redact", "eval", "-h", "--help"):
        argv = ["redact", *argv]
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("veilspan").getOrCreate()
    if args.command == "redact":
        if args.texts:
            df = spark.createDataFrame([(t,) for t in args.texts], "text string")
        elif args.input:
            df = (records.read_texts if args.whole_files else records.read_lines)(spark, args.input)
        else:
            df = spark.createDataFrame([(x.rstrip("\r\n"),) for x in sys.stdin if x.strip()], "text string")
        engine = redact.Redactor(mode=args.output_mode, trim_whitespace=not args.no_trim_whitespace)
        out = engine.transform(df).select(F.col("redacted_text").alias("value")) if args.text_only else engine.results(df).select(F.col("result").alias("value"))
        if args.output:
            out.write.text(args.output)
        else:
            for row in out.toLocalIterator():
                print(row["value"])
        return 0
    df = records.numbered(records.read_records(spark, args.dataset, placed=True), records.PLACE).drop(*records.PLACE)
    df = records.stable_ids(df)
    if args.dataset_variant == "message":
        df = records.explode_messages(df, "example_id")
        df = df.withColumn("example_id", F.concat_ws("/", "example_id", "message_index")).withColumn("label", F.lit(None).cast("array<struct<category:string,start:bigint,end:bigint>>"))
    if args.skip_non_ascii_examples:
        df = df.where(~F.col("text").rlike("[^\\x00-\\x7F]"))
    gold = records.validated(records.gold_spans(df), df)
    found = spans.select_non_overlapping(redact.detect(F.col("text")))
    typed = args.eval_mode == "typed"
    result = metrics.span_metrics(redact.spans_long(df, "example_id", found), gold, typed, "example_id")
    if not typed:
        recall = metrics.ground_truth_label_recall(gold, redact.spans_long(df, "example_id", found), "example_id")
        result = result.unionByName(recall.select(F.concat(F.lit("ground_truth_label_recall.recall."), F.col("label")).alias("metric"), F.col("recall").alias("value")))
    if args.predictions:
        sinks.write_predictions(df.withColumn("_s", found), args.predictions, "_s")
    if args.metrics:
        sinks.write_metrics(result, args.metrics, args=vars(args))
    result.orderBy("metric").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
