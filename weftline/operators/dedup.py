"""First-, last- and best-wins deduplication. List positions are columns, so no result depends on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _expr(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def best_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (make it total).

    Written as a minimum of (order, row) structs: combined map-side, so a key that holds most rows is one row per task
    in the shuffle, where a window would gather and sort them all. An order column may be descending if numeric.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ranks = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    least = df.groupBy(*[_expr(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, ranks).alias("_row"))
    return least.select("_row.*")


def first_wins(df: DataFrame, keys: Sequence[str | Column], pos: str = "pos") -> DataFrame:
    return best_wins(df, keys, [F.col(pos)])


def first_by_priority(df: DataFrame, keys: Sequence[str | Column], priority: str = "priority", pos: str = "pos") -> DataFrame:
    """First wins after a stable sort by source priority."""
    return best_wins(df, keys, [F.col(priority), F.col(pos)])


def last_wins(df: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The last row of each key, with ``first_pos``: the position its key first had."""
    row = F.struct(*[F.col(c) for c in df.columns])
    held = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, pos).alias("_row"), F.min(pos).alias("first_pos"))
    return held.select("_row.*", "first_pos")


def most_confident(df: DataFrame, keys: Sequence[str] = ("alias", "district"), confidence: str = "confidence", pos: str = "pos") -> DataFrame:
    """Highest confidence wins; a tie stays with what came first."""
    return best_wins(df, keys, [-F.col(confidence), F.col(pos)])


def new_rows(df: DataFrame, history: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """First row of each key that the history has not seen (null keys match null)."""
    seen = history.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return first_wins(df.join(seen, same, "left_anti"), list(keys), pos)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the limit is applied before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def candidate_window(df: DataFrame, group: Sequence[str], order: Sequence[Column], same: Sequence[str], k: int) -> DataFrame:
    """Top ``max(3 k, 10)`` of each group, deduplicated by ``same`` within them, then the top ``k``: fewer may remain, for
    rows below the window never move up."""
    window = top_per_group(df, group, order, max(3 * k, 10), "_window")
    firsts = top_per_group(window, [*group, *same], [F.col("_window")], 1, "_copy")
    return top_per_group(firsts, group, [F.col("_window")], k).drop("_window", "_copy")
