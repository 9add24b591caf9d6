"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (columns a, b: long) with the smallest node it reaches.

    Every step maps a node's neighbours to the smallest of them, which keeps connectivity and never adds edges; the number
    of rounds is logarithmic in the size of a component. The minima are combined map-side and written, so a hub with very
    many neighbours is an ordinary skewed join side that AQE can split, never one task's group. Edges with a null end and
    self-loops are ignored; an empty table gives an empty result.
    """
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialise(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
        down = large.filter("a < b")
        least = materialise(down.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
        linked = down.withColumnRenamed("b", "u").join(least, "u")
        step = linked.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialise(step.filter("a < b").distinct(), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.union(now.select(F.col("b").alias("node"), F.col("a").alias("component")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum, to tell that a round changed nothing."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])
