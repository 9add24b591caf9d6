"""Set operations on rows by key; null keys match null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _same(other: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    slim = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    return slim, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def present(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``other`` has. Its keys are made distinct map-side first, so a frequent one moves once a task."""
    slim, same = _same(other, keys)
    return df.join(slim, same, "left_semi")


def absent(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``other`` lacks."""
    slim, same = _same(other, keys)
    return df.join(slim, same, "left_anti")
