"""Results kept by request and version of the data they came from: only requests that were not seen at this version are computed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.workspace import small


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def content_key(*columns: Column) -> Column:
    """SHA-256 (hex) of the values; null is another value than any text."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(f"c{k}") for k, c in enumerate(columns)])), 256)


def corpus_version(docs: DataFrame, *more: str) -> str:
    """A name for these rows, in any order, and for ``more`` (settings that change results): another row, value or copy gives another name.

    Two sums of row hashes, combined map-side; no row moves.
    """
    values = [F.to_json(c) if kind.startswith(("array", "map", "struct")) else c for c, (_, kind) in zip(_cols(docs.columns), docs.dtypes, strict=True)]
    flags = [c.isNull() for c in _cols(docs.columns)]
    total = lambda *salt: F.sum(F.xxhash64(*salt, *values, *flags).cast("decimal(38,0)"))
    row = docs.agg(F.count("*"), total(), total(F.lit("again"))).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, "|".join(map(str, [*row, *docs.dtypes, *more]))).hex


@dataclass(frozen=True)
class Memo:
    """A folder that driver and executors share. Results of a version lie below ``version=...``; each run adds one folder, which counts once
    Spark has marked it complete, so a run that dies leaves nothing that is read. Two runs at a time may compute the same
    request twice; one of the two equal results is used."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _below(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def parts(self, version: str) -> list[str]:
        """Complete folders of a version."""
        done = []
        for part in self._below(f"{self.path}/version={version}"):
            fs, mark = self._fs(f"{part}/_SUCCESS")
            done += [part] if fs.exists(mark) else []
        return done

    def versions(self) -> list[str]:
        return [p.rpartition("version=")[2] for p in self._below(self.path)]

    def drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def invalidate(self, keep: str) -> list[str]:
        """Delete the results of all other versions; their names."""
        gone = [v for v in self.versions() if v != keep]
        for v in gone:
            self.drop(f"{self.path}/version={v}")
        return gone

    def stored(self, version: str) -> DataFrame | None:
        """(key, results) kept at a version, one row a key; None where there is nothing."""
        parts = self.parts(version)
        if not parts:
            return None
        rows = self.spark.read.parquet(*parts)
        return rows if len(parts) == 1 else rows.groupBy("key").agg(F.any_value("results").alias("results"))

    def compact(self, version: str) -> None:
        """The folders of a version as one. A reader that has listed the old ones has to list again."""
        old = self.parts(version)
        if len(old) > 1:
            self.stored(version).write.parquet(f"{self.path}/version={version}/part={uuid.uuid4().hex}")
            for part in old:
                self.drop(part)

    def answers(self, requests: DataFrame, by: Sequence[str], version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``requests`` with ``results`` (array of structs, in their order) and ``fresh`` (whether this run computed them).

        Requests are equal where the columns ``by`` are (null equals null). ``compute`` takes (query_id, and the columns ``by``), a row for each request that this version has not seen, and
        gives rows with query_id and whatever a result holds, a bounded number for each; a request without a row has an empty array, which is
        kept too. Equal requests are combined map-side before anything moves, so a request that makes up a third of all rows is one row.
        """
        keyed = requests.withColumn("_key", content_key(*_cols(by)))
        distinct = keyed.groupBy(F.col("_key").alias("query_id")).agg(F.any_value(F.struct(*_cols(by))).alias("_r")).select("query_id", "_r.*")
        before = self.stored(version)
        unseen = distinct if before is None else distinct.join(before.select(F.col("key").alias("query_id")), "query_id", "left_anti")
        todo = f"{self.path}/work-{uuid.uuid4().hex}"
        unseen.write.parquet(todo)
        unseen = self.spark.read.schema(unseen.schema).parquet(todo)
        parts = set(self.parts(version))
        try:
            found = compute(unseen)
            row = F.struct(*_cols([c for c in found.columns if c != "query_id"]))
            lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
            out = unseen.select("query_id").join(lists, "query_id", "left").select(F.col("query_id").alias("key"), F.coalesce("results", F.array().cast(lists.schema["results"].dataType)).alias("results"))
            mine = f"{self.path}/version={version}/part={uuid.uuid4().hex}"
            out.write.parquet(mine)
        finally:
            self.drop(todo)
        new = self.spark.read.schema(out.schema).parquet(mine).withColumn("fresh", F.lit(True))
        old = self.spark.read.schema(out.schema).parquet(*sorted(parts)).groupBy("key").agg(F.any_value("results").alias("results")).withColumn("fresh", F.lit(False)) if parts else None
        kept = small(new if old is None else new.unionByName(old.join(new.select("key"), "key", "left_anti")))
        return keyed.join(kept, F.col("_key") == F.col("key"), "left").drop("_key", "key")
