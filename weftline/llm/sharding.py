"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame operations only)."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise

#: Most source partitions; their number times the shards bounds what the driver draws.
MAX_PARTITIONS = 4096
#: Most rows that one task permutes after the exchange, on average.
ROWS_PER_CELL = 1_000_000
#: Populations up to here use numpy's sampler; beyond, standard deviations on either side of the mode that a draw can reach.
_NUMPY_MOST, _TAIL = 10**9 - 1, 14.0


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart that sum to ``rows``."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw. Beyond numpy's range by inversion: weights relative to that of the mode follow from exact ratios of
    neighbours and are normalised by their own sum, so no large logarithm is subtracted from another (relative error about
    1e-10, and 1e-40 of the mass, beyond ``_TAIL`` deviations, is left out)."""
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return draws
    total = good + bad
    if total <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    mode = (draws + 1) * (good + 1) // (total + 2)
    reach = int(_TAIL * (draws * (good / total) * (bad / total) * max(0, total - draws) / max(1, total - 1)) ** 0.5) + 40
    low, high = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    k = np.arange(mode, high, dtype=np.float64)
    up = np.cumprod((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)))
    k = np.arange(mode, low, -1, dtype=np.float64)
    down = np.cumprod(k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1)))
    weights = np.cumsum(np.concatenate((down[::-1], [1.0], up)))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each source partition sends to each shard, as under a uniform permutation of all rows.

    Row sums are ``counts``, column sums ``sizes``: each partition in turn draws its rows from what the shards still hold.
    """
    rng = np.random.default_rng(seed)
    left, total, out = list(sizes), sum(sizes), []
    for n in counts:
        row, todo, rest = [], n, total
        for k, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, todo)
            row.append(x)
            left[k] -= x
            todo -= x
        total -= n
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Shard counts are at most one apart. Each source partition permutes its rows by sorting on a seeded hash, deals exactly
    the drawn number to each shard, and after the exchange each shard permutes again; every assignment of rows to shards
    of those sizes is equally likely. Only (id, size, checksum) move, never texts. Rows are dealt by count alone, so a
    source, key or group of copies of any size spreads over all shards.

    Sizes are the text's UTF-8 bytes plus 16. Null text has no bytes; null ids and repeated rows are rows like any other;
    an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = materialise(slim, "slim").coalesce(MAX_PARTITIONS)  # texts are read by all tasks of the scan, slim rows by fewer
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    mixed = slim.sortWithinPartitions(key, "doc_id")  # the first permutation, without a shuffle
    place = F.monotonically_increasing_id()  # partition number, then place in it
    local = materialise(mixed.withColumn("_at", place).withColumns({"part": F.shiftright("_at", 33).cast("int"), "place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), "local")
    counts = local.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # at most MAX_PARTITIONS rows
    rows = sum(r["n"] for r in counts)
    matrix = communication_matrix([r["n"] for r in counts], shard_sizes(rows, shards), seed)
    ends = [{"p": r["part"], "ends": np.cumsum(x).tolist()} for r, x in zip(counts, matrix, strict=True)]
    dealt = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<p:int,ends:array<bigint>>>")).alias("x")).select("x.p", "x.ends")
    assigned = local.join(F.broadcast(dealt), F.col("part") == F.col("p")).withColumn("shard", F.expr("cast(size(filter(ends, e -> e <= place)) AS int)"))
    # Second permutation: cells cut a shard by its hash range, so no task holds a whole shard of a large table.
    cells = max(1, -(-rows // (shards * ROWS_PER_CELL)))
    again = F.xxhash64(F.lit(seed + 1), "part", "place")
    moved = assigned.select("doc_id", "size", "text_crc32", "shard", again.alias("turn"), "part", "place").withColumn("cell", F.expr(f"cast((turn / 18446744073709551616D + 0.5D) * {cells} AS int)"))
    moved = materialise(moved, "moved")
    before = moved.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n"))
    ranked = moved.withColumn("k", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("turn", "part", "place")))
    base = F.broadcast(before.select(F.col("shard").alias("_s"), F.col("cell").alias("_c"), "base"))  # shards x cells rows
    out = ranked.join(base, (F.col("shard") == F.col("_s")) & (F.col("cell") == F.col("_c")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("k") - 1 + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
