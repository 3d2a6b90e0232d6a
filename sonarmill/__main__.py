"""python -m sonarmill JOB ...: the jobs of the pipeline, and any query over a data folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sonarmill.plans import pipeline, registry, stream_queries
from sonarmill.sources import adapters, audio, tables


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sonarmill")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, text in (("manifest", "labelled rows of all datasets"), ("background", "rows without a drone"), ("splits", "canonical rows with their split"), ("validate", "header metadata and issues"), ("preflight", "checks and counts of a canonical manifest"), ("rebuild", "every layer, into a new folder"), ("npz", "shards as NPZ files")):
        job = jobs.add_parser(name, help=text)
        job.add_argument("--data", required=True), job.add_argument("--output", required=True)
        job.add_argument("--seed", type=int, default=42), job.add_argument("--shard-size", type=int, default=256)
    query = jobs.add_parser("query", help="a query by name")
    query.add_argument("name", choices=sorted(registry.QUERIES)), query.add_argument("--data", required=True), query.add_argument("--output")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"sonarmill {a.job}").getOrCreate()
    if a.job == "query":
        df = registry.QUERIES[a.name](spark, a.data)
        tables.write_table(df, a.output) if a.output else df.show(50, truncate=False)
        return 0
    options = pipeline.Options(seed=a.seed, shard_size=a.shard_size)
    if a.job == "manifest":
        tables.write_table(adapters.with_label(pipeline.dataset_rows(spark, a.data, stream_queries.RULES), 1), a.output)
    elif a.job == "background":
        tables.write_table(adapters.with_label(pipeline.dataset_rows(spark, a.data, stream_queries.ALL_RULES), 0), a.output)
    elif a.job == "splits":
        canonical, quarantined = pipeline.prepared_splits(spark.read.parquet(a.data), options)
        tables.write_table(canonical, f"{a.output}/manifest", ("split",)), tables.write_table(quarantined, f"{a.output}/conflicts")
    elif a.job == "validate":
        tables.write_table(pipeline.validated(audio.audio_files(spark, a.data, content=True)), a.output)
    elif a.job == "preflight":
        tables.write_json_report(pipeline.preflight(spark.read.parquet(a.data)), a.output)
    elif a.job == "rebuild":
        print(pipeline.rebuild(spark, a.data, a.output, stream_queries.ALL_RULES, options))
    elif a.job == "npz":
        tables.write_table(pipeline.export_npz(spark.read.parquet(a.data), a.output), f"{a.output}/manifest")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
