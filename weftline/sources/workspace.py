"""Working files in the folder that driver and executors share, and the package itself for the executors' Python."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    A temporary folder stands in only where the session names none and driver and executors are one process (as in tests);
    on a cluster a missing setting is an error, since executors cannot read the driver's own folders.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working file that nothing reads any more."""
    with contextlib.suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        remove(spark, path)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Working files written inside go at its end, but those whose paths are in the list it gives. For a step whose result is written
    inside and listed; nothing else of the step may be read afterwards."""
    before, kept = len(_written), []
    try:
        yield kept
    finally:
        inside = _written[before:]
        _written[before:] = [(spark, path) for spark, path in inside if path in kept]
        for spark, path in inside:
            if path not in kept:
                remove(spark, path)


def table_bytes(df: DataFrame) -> int:
    """The planner's size estimate; for a written table the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts lineage, survives lost executors, gives the planner a true size."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side whose files are no larger than this is broadcast, if its rows take no more than so much memory; anything larger takes the shuffled path.
BROADCAST_BYTES, MEMORY_BYTES = 8 << 20, 32 << 20


def memory_bytes(df: DataFrame) -> int:
    """About what the rows of ``df`` take in memory: their number times the planner's width of a row."""
    return df.count() * (16 + int(df._jdf.schema().defaultSize()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit``, else with one for a shuffled join (AQE splits skew): files of
    columns that repeat hold far more rows than they show, and by their size alone the planner would have the driver take them."""
    size = table_bytes(df)
    if size <= limit and (size <= limit >> 11 or memory_bytes(df) <= MEMORY_BYTES):
        return F.broadcast(df)
    return df.hint("merge")


#: A table of fewer bytes for each core is dealt over all cores before work that is done row by row.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if the planner's estimate of its size is small (a small file is one partition, whatever the work on
    its rows); a large table stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if table_bytes(df) < SPREAD_BYTES * cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that functions defined in it can be unpickled there whatever
    their own path holds. It has to come before such a function is made into a plan. Does nothing where the package is not a
    folder (it was shipped as an archive already)."""
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="weftline-code-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
