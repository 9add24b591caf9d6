"""Approximate nearest neighbours by collision counting over sorted single projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise, prepare

#: Vectors of an index block and queries of a query block, on average: some 20 MB each in a task. Every vector moves once for
#: each block of queries, every query once for each block of the index.
BLOCK, QUERIES = 16384, 16384
#: Projections; collisions that make a candidate; half-width of a full window in standard deviations of a projected distance.
PROJECTIONS, THRESHOLD, WIDTH = 48, 37, 1.45
#: The first window as a part of a full one for distance 1, and the factor by which virtual rehashing widens windows.
FIRST, GROWTH = 0.7, 1.25


def projections(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random directions of unit length, as columns."""
    a = np.random.default_rng(seed).standard_normal((dim, count))
    return a / np.linalg.norm(a, axis=0)


class SortedArrays:
    """An index block: each projection of the block's unit vectors, sorted, with the vectors' places."""

    def __init__(self, unit: np.ndarray, directions: np.ndarray) -> None:
        values = np.ascontiguousarray((unit @ directions).T)
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.rows, self.dim = len(unit), unit.shape[1]


def search_block(index: SortedArrays, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, directions: np.ndarray, k: int, threshold: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the block's candidates for one query, nearest first, ties to the smaller id: the ``k`` best found, of
    distinct ids.

    Windows centred at the query's projections widen step by step over the sorted arrays, and only the entries that a step
    adds are counted; vectors that reach the threshold are verified with their exact cosine. The search ends once a full
    window for the k-th best distance d has been counted: a vector at distance d then lies in each window with the
    probability that ``width`` gives (a projected distance has standard deviation d / sqrt(dim)).
    """
    norm = float(np.sqrt((query * query).sum()))
    at = (query / norm) @ directions
    rows, m = index.rows, len(at)
    low = np.fromiter((np.searchsorted(index.values[i], at[i]) for i in range(m)), np.int64, m)
    high = low.copy()
    hits = np.zeros(rows, np.int64)
    verified = np.zeros(rows, bool)
    found, cosines = np.empty(0, np.int64), np.empty(0)
    scale = width / np.sqrt(index.dim)
    half = FIRST * scale
    while True:
        new = []
        for i in range(m):
            a, b = np.searchsorted(index.values[i], (at[i] - half, at[i] + half + 1e-12))
            a, b = min(a, low[i]), max(b, high[i])
            new += [index.order[i, a : low[i]], index.order[i, high[i] : b]]
            low[i], high[i] = a, b
        hits += np.bincount(np.concatenate(new), minlength=rows)
        fresh = np.flatnonzero((hits >= threshold) & ~verified)
        if len(fresh):
            verified[fresh] = True
            fresh = fresh[ids[fresh] != query_id]
            score = (vectors[fresh] * query).sum(axis=1) / (norms[fresh] * norm)
            found, cosines = np.concatenate([found, fresh]), np.concatenate([cosines, score])
            best = np.lexsort((ids[found], -cosines))
            best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]  # of rows that repeat an id the nearest
            found, cosines = found[best], cosines[best]
        if len(found) == k and half >= scale * np.sqrt(max(0.0, 2 - 2 * cosines[-1])):
            return found, cosines
        if half > 2:  # every entry of every array has been counted
            return found, cosines
        half *= GROWTH


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of vectors that take part: not null, not zero, all components finite."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    big = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & fine)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: neither squares nor sums over- or underflow, and
    all digits, so all cosines, stay."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def _cell(k: int, seed: int, count: int, threshold: int, width: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, block in left.groupby(left["v"].map(len)) if len(left) else []:
            asked = right[right["v"].map(len) == dim]
            if not len(asked):
                continue
            block = block.sort_values("vec_id")
            vectors, ids = scaled(np.stack(block["v"].to_numpy())), block["vec_id"].to_numpy()
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            directions = projections(dim, count, seed)
            index = SortedArrays(vectors / norms[:, None], directions)
            for query_id, v in zip(asked["vec_id"], asked["v"], strict=True):
                found, cosines = search_block(index, vectors, norms, ids, scaled(np.asarray(v, float)), query_id, directions, k, threshold, width)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found], "score": cosines}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest_neighbours(
    rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, count: int = PROJECTIONS, threshold: int = THRESHOLD, width: float = WIDTH
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every`` its ``k`` nearest by cosine.

    Every valid vector is indexed. Index blocks meet query blocks; in a cell each query expands windows over the block's sorted
    projections and verifies the vectors that collide often enough, all of them (there is no cap on candidates). A cell
    gives at most ``k`` rows per query, and these are ranked over all blocks. If the block has no more than ``k`` candidates
    all are returned. Equal vectors collide alike, so a group of copies of any size stays whole within its blocks, which
    are dealt by a hash of the id; ties go to the smaller id.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null id; vectors
    meet only others of their length. Of rows that repeat an id each takes part, but not against its own id, and the nearest stands
    for the id: an id is listed once. An empty table gives an empty result. Other columns are ignored.

    Work: a query costs in proportion to the vectors that its windows cover. Where these are a fixed part of all (vectors without
    structure in many dimensions, whose nearest neighbours are hardly nearer than others), that is the number of vectors.
    """
    prepare(rows.sparkSession)
    held = materialise(valid_vectors(rows, id_col, vec_col), "vectors")
    blocks = max(1, -(-held.count() // BLOCK))
    asked = held.filter(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // QUERIES))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    index = held.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("ib"), spread(parts, "qb"))
    queries = asked.select("vec_id", "v", spread(blocks, "ib"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("qb"))
    cells = index.groupBy("ib", "qb").cogroup(queries.select("vec_id", "v", "ib", "qb").groupBy("ib", "qb"))
    near = cells.applyInPandas(_cell(k, seed, count, threshold, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
