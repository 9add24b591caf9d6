"""Shared helpers of the training-data operators: intermediate tables, text columns, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.workspace import shared_path, ship, table_bytes

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Rows of one Arrow batch where whole texts go through Python: batches of a few MB, so a worker's memory stays small.
TEXT_BATCH = 1000
#: Shuffle files of a statement go when it ends, not when the driver's memory happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def prepare(spark: SparkSession) -> None:
    """What Python work needs, before its functions are made into a plan: the package on the executors, and Arrow batches of
    ``TEXT_BATCH`` rows where the session still has Spark's default (a caller's own setting stays)."""
    ship(spark)
    if spark.conf.get(_ARROW_ROWS) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_ROWS, str(TEXT_BATCH))


def give_back() -> None:
    """Return freed memory to the system: workers are used again for other work, and what one task freed adds to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def give_back_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage: what earlier work left on a heap, and in buffers beside it, returns to the system,
    where it would add to the memory of the Python workers to come.

    A JVM that is not short of memory keeps a heap at its widest. One short task a core; an executor whose cores are all taken may get none,
    then it stays as it is.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


_kept: dict[str, dict] = {}


def kept(work: str) -> dict:
    """What a worker keeps from one task to the next of the same work; it goes when the worker begins other work."""
    return _kept.setdefault(work, {})


def let_go(work: str = "") -> None:
    """Drop what is kept for any other work."""
    for other in [w for w in _kept if w != work]:
        del _kept[other]


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, work: str = "") -> DataFrame:
    """``df.mapInArrow`` after ``prepare``; a task gives its memory back at its end, but for what is ``kept`` for its ``work``."""
    prepare(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(work)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def by_group(run: Callable[[object], object]) -> Callable[[object], object]:
    """A function of one group for ``applyInPandas`` or ``applyInArrow`` that gives its memory back when the group is done."""

    def whole(group):
        let_go()
        try:
            return run(group)
        finally:
            give_back()

    return whole


def by_key(run: Callable[[tuple, object], object]) -> Callable[[tuple, object], object]:
    """``by_group`` for a function of a group's key and rows."""

    def whole(key, group):
        let_go()
        try:
            return run(key, group)
        finally:
            give_back()

    return whole


@contextlib.contextmanager
def without_gc() -> Iterator[None]:
    """No cyclic garbage collection inside: each full one walks all objects of a batch. The worker's setting is put back."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors, and gives
    the planner a true size. What was shuffled for it goes with the statement; the session's own setting is put back."""
    spark = df.sparkSession
    path, was = shared_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """Column names that ``df`` does not have, in any case of letters: for helper columns beside a caller's own."""
    have, out = {c.lower() for c in df.columns}, []
    for label in labels:
        name = f"_{label}"
        while name.lower() in have:
            name = f"_{label}_{uuid.uuid4().hex[:8]}"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their literal names, dots and all."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


#: A side whose files are no larger than this is broadcast; anything larger takes the shuffled path.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit``, else unchanged (shuffled join, AQE splits skew)."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A pure-ASCII text takes the byte-wise path, any other ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_keys(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """(key, label): of each class the ``per_class`` distinct keys of the smallest hash.

    The class's number of distinct keys (an estimate, which needs no shuffle of keys) gives a hash below which about three times
    ``per_class`` of them lie. Only these are made distinct, and the smallest are picked on the driver, from a number of keys that
    depends on ``per_class`` and the classes alone; no task ranks a class.
    """
    sizes = materialise(rows.groupBy(label).agg(F.approx_count_distinct(key, 0.02).alias("_n")).withColumnRenamed(label, "_label"), "classes")
    place = F.xxhash64(key) / F.lit(float(1 << 64)) + 0.5
    low = rows.select(key, label).join(small(sizes), F.col(label) == F.col("_label")).filter(place * F.col("_n") < 3 * per_class + 50)
    of: dict = {}
    for r in low.select(F.xxhash64(key).alias("_hash"), key, label).distinct().collect():
        of.setdefault(r[label], []).append((r["_hash"], r[key]))
    chosen = [(k, c) for c in of for _, k in sorted(of[c])[:per_class]]
    return rows.sparkSession.createDataFrame(chosen, rows.select(key, label).schema)


#: A text of more bytes is not learned from in a sample that goes to the driver.
SAMPLE_TEXT_BYTES = 1 << 16


def bounded_sample(rows: DataFrame, texts: DataFrame, key: str, label: str, per_class: int, most_bytes: int = SAMPLE_TEXT_BYTES) -> DataFrame:
    """(key, label, text): at most ``per_class`` rows of each class (``sampled_keys``) with their whole texts of at most ``most_bytes``.

    So the sample is bounded in rows and bytes. The chosen keys are few (classes x per_class) and are broadcast, texts stay
    where they are. Of rows that repeat a key with different texts the smallest text is taken, in every run.
    """
    chosen = sampled_keys(rows, key, label, per_class)
    fit = texts.filter(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), [key, label] if label in texts.columns else [key])
    return fit.groupBy(key, label).agg(F.min("text").alias("text"))
