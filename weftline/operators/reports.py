"""Artifact, readiness and acceptance reports over file listings; latest and archived report files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifact_report(files: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """(artifact, present, missing, complete) of each artifact: which of its required files a listing (path) has."""
    spark = files.sparkSession
    want = spark.createDataFrame([(a, f) for a, fs in required.items() for f in fs], "artifact string, file string")
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("file")).distinct().withColumn("_there", F.lit(True))
    rows = want.join(have, "file", "left").groupBy("artifact").agg(F.count_if(F.col("_there").isNotNull()).alias("present"), F.array_sort(F.collect_list(F.when(F.col("_there").isNull(), F.col("file")))).alias("missing"))
    return rows.withColumn("complete", F.size("missing") == 0)


def readiness(report: DataFrame, needed: Sequence[str]) -> DataFrame:
    """One row (ready, missing): whether every needed artifact is complete."""
    bad = report.filter(F.col("artifact").isin(*needed) & ~F.col("complete")).agg(F.array_sort(F.collect_list("artifact")).alias("missing"))
    return bad.select((F.size("missing") == 0).alias("ready"), "missing")


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The checkpoint path with the largest number; none without a number."""
    n = F.regexp_extract("path", r"checkpoint-(\d+)/?$", 1).try_cast("bigint")
    return paths.withColumn("step", n).filter("step IS NOT NULL").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step")).filter("path IS NOT NULL")


def write_report(spark: SparkSession, report: DataFrame, folder: str, name: str, now: datetime) -> list[str]:
    """Write a report of few rows as ``name.json`` and as a timestamped archive beside it; the paths."""
    text = json.dumps([r.asDict(recursive=True) for r in report.collect()], ensure_ascii=False, indent=2, default=str)
    jvm = spark._jvm.org.apache.hadoop.fs
    out = []
    for path in (f"{folder}/{name}.json", f"{folder}/archive/{name}_{now:%Y%m%d_%H%M%S}.json"):
        p = jvm.Path(path)
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        out.append(path)
    return out


def mean_latency(events: DataFrame, by: str, value: str) -> DataFrame:
    """Mean latency by backend and its ratio to the fastest's."""
    means = events.groupBy(by).agg(F.avg(value).alias("mean_latency"))
    return means.join(means.agg(F.min("mean_latency").alias("_least")), F.lit(True), "inner").select(by, "mean_latency", F.try_divide("mean_latency", "_least").alias("ratio"))
