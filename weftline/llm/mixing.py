"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import by_key, fresh, materialise, prepare, quoted, small

#: Rows that one leaf of the tree rounds, on average; leaves or nodes that one node above combines.
ROWS_PER_LEAF, FAN_IN = 50_000, 64
#: No document is taken more often than this.
MOST_COPIES = 3
_EPS = 1e-9
#: A document of more than this part of its source's words in a leaf is paired with all smaller ones at once.
LARGE_SHARE = 256
_WORDS = r"[^\x20\x09-\x0D]+"


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, g1, g2): words of each whole text, separated by \\x20 and \\x09-\\x0D (null text has none), and two hashes
    that name the row's id, source and text."""
    text, doc_id, source = F.col(text_col).cast("string"), F.col(id_col).cast("long"), F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), *_names(doc_id, source, text))


def _names(doc_id: Column, source: Column, text: Column) -> list[Column]:
    empty = [c.isNull() for c in (doc_id, source, text)]  # a null leaves a hash as it is
    return [F.xxhash64(F.lit(k), *empty, doc_id, source, text).alias(f"g{k}") for k in (1, 2)]


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their number (from 0) among the rows of equal keys, in any order.

    A key is numbered piecewise, by the partition a row lies in, and the pieces are offset by their counts: no task holds
    all rows of a frequent key. The partition is written with the row, so a repeated task gives the same numbers.
    """
    (part,) = fresh(rows, "part")
    held = materialise(rows.withColumn(part, F.spark_partition_id()), "numbered")
    pieces = held.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    base = (F.sum("_n").over(Window.partitionBy(*keys).orderBy(part)) - F.col("_n")).alias("_base")
    base = materialise(pieces.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(part).alias("_of_part"), base), "pieces")
    at = F.row_number().over(Window.partitionBy(*keys, part).orderBy(part)) - 1
    same = F.col(part) == F.col("_of_part")
    for k in keys:
        same &= F.col(k) == F.col(f"_of_{k}")
    return held.withColumn("_at", at).join(small(base), same).withColumn(name, F.col("_at") + F.col("_base")).select(*quoted(rows.columns), name)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3 repeating over the sources by code point, null last, share the whole;
    a target stops at ``MOST_COPIES`` times its source's size and the excess is shared again by weight.

    Sources may be many (hosts): they are ranked in the partitions of a distributed sort, and the shares settle by rounds of one
    aggregation each: the level that the sources below their caps share, until no further one reaches its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = materialise(per.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = per.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    base = counts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("base")
    named = per.join(F.broadcast(base), F.col("part") == F.col("_part")).withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MOST_COPIES)
    named = materialise(named.select("source", "source_size", "weight", "cap"), "weights")
    level, known = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        row = named.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if row[3] == known or row[2] is None:
            break
        level, known = (row[0] - (row[1] or 0)) / row[2], row[3]
    return named.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def pivotal_step(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """One pairing of fractional copies p and q of documents of a and b words.

    Words move from one to the other until one is integral: p a + q b is kept exactly, and the direction is drawn so that
    the expected copies of both are kept.
    """
    gain, loss = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (gain + loss) < loss:
        p, q = p + gain / a, q - gain / b
    else:
        p, q = p - loss / a, q + loss / b
    return p, q


def _integral(p: float) -> bool:
    return p < _EPS or p > 1 - _EPS


def settle_large(sizes: list[int], parts: list[float], rng: np.random.Generator) -> int:
    """Round the leading documents of more than 1 / ``LARGE_SHARE`` of the source's words here; how many were rounded.

    All fractions are alike and sizes fall. Each large document is paired with the pool of all that follow: it is taken
    with its fraction as probability, and the words that it gains or gives up are spread over the pool as a change of the
    common fraction. So words and expected copies are kept, and no large document is left to the end, where what stays
    fractional is rounded alone. It stops where the pool could not take the change.
    """
    pool = total = sum(sizes)
    for k, size in enumerate(sizes):
        p, rest = parts[k], pool - size
        if size * LARGE_SHARE <= total or _integral(p) or p * rest < (1 - p) * size or (1 - p) * rest < p * size:
            return k
        taken = rng.random() < p
        parts[k] = float(taken)
        parts[k + 1 :] = [p - (1 - p) * size / rest if taken else p + p * size / rest] * (len(parts) - k - 1)
        pool = rest
    return len(sizes)


def round_source(sizes: list[int], parts: list[float], rng: np.random.Generator) -> tuple[list[float], int]:
    """Round the fractional parts of one source in order; the place of the one that stays fractional, or -1."""
    held = -1
    start = settle_large(sizes, parts, rng) if max(parts) - min(parts) < _EPS and min(sizes) > 0 else 0
    for k in range(start, len(parts)):
        p = parts[k]
        if sizes[k] <= 0 or _integral(p):
            parts[k] = float(p > 0.5)
            continue
        if held < 0:
            held = k
            continue
        x, y = pivotal_step(parts[held], sizes[held], p, sizes[k], rng.random())
        parts[held], parts[k] = x, y
        if _integral(x):
            parts[held] = round(x)
            held = k
        if _integral(parts[k]):
            parts[k] = round(parts[k])
            held = -1 if held == k else held
    return parts, held


def _rounded(pdf: pd.DataFrame, seed: int, node: int, last: bool) -> pd.DataFrame:
    """Round each source's rows of a leaf or node, largest first so that what stays fractional tends to be small; column
    ``part`` then has the fraction of rows not yet decided, else null."""
    if (pdf["size"] <= 0).all():
        return pdf.assign(part=np.nan, node=node // FAN_IN)
    pdf = pdf.sort_values(["size", "turn", "j"], ascending=[False, True, True], kind="stable")
    out = []
    for source, rows in pdf.groupby("source", dropna=False, sort=True):
        salt = 0 if pd.isna(source) else zlib.crc32(str(source).encode()) + 1
        rng = np.random.default_rng([seed, node, salt])
        full = int((rows["size"] > 0).sum())  # rows without words come last and take no part
        parts, held = round_source(rows["size"].tolist()[:full], rows["part"].tolist()[:full], rng) if full else ([], -1)
        parts += [0.0] * (len(rows) - full)
        if held >= 0 and last:
            parts[held], held = float(rng.random() < parts[held]), -1
        parts = np.array(parts)
        open_ = np.arange(len(parts)) == held
        out.append(rows.assign(copies=rows["copies"].to_numpy() + np.where(open_, 0, np.rint(parts)).astype(np.int64), part=np.where(open_, parts, np.nan), node=node // FAN_IN))
    return pd.concat(out) if out else pdf


def _step(seed: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    return lambda key, pdf: _rounded(pdf, seed, int(key[0]), last)


def _decided(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, g1, g2, j, copies; see ``mix``. ``j`` numbers equal rows."""
    sized = materialise(word_sizes(docs, id_col, text_col, source_col), "sized")
    targets = materialise(source_targets(sized), "targets").withColumnRenamed("source", "_s")
    leaves = max(1, -(-sized.count() // ROWS_PER_LEAF))
    repeated = materialise(sized.groupBy("g1", "g2").count().filter("count > 1").select(F.col("g1").alias("_g1"), F.col("g2").alias("_g2")), "repeated")
    same = (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2"))
    rows = sized.join(small(repeated), same, "left_anti").withColumn("j", F.lit(0).cast("long"))
    rows = rows.unionByName(numbered(sized.join(small(repeated), same, "left_semi"), ["g1", "g2"], "j"))
    rows = rows.join(small(targets), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    turn = F.xxhash64(F.lit(seed), "g1", "g2", "j")
    rows = rows.withColumn("x", whole).select(
        "doc_id", "source", "size", "source_size", "target", "g1", "g2", "j", F.floor("x").alias("copies"), (F.col("x") - F.floor("x")).alias("part"), turn.alias("turn"), F.pmod(turn, F.lit(leaves)).alias("node")
    )
    prepare(docs.sparkSession)
    shape = "doc_id long, source string, size long, source_size long, target double, g1 long, g2 long, j long, copies long, part double, turn long, node long"
    level, done = 0, []
    while True:
        last = leaves == 1
        keys = ["node"] if level == 0 else ["node", "source"]
        rows = materialise(rows.groupBy(*keys).applyInPandas(by_key(_step(seed + level, last)), shape), "rounded")
        done.append(rows.filter("part IS NULL"))
        if last:
            break
        rows, level, leaves = rows.filter("part IS NOT NULL"), level + 1, -(-leaves // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "turn", "node")


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    Each document of a source is expected target / source_size times, at most ``MOST_COPIES``; its fractional part is rounded
    with the others of its source, and what leaves one document goes to another, so a source's taken words differ from
    its target by less than one document. Leaves round about ``ROWS_PER_LEAF`` rows each, dealt by a hash of the row, so a
    source of any share spreads over all leaves, and so do the repeats of one row, which are numbered; a leaf leaves at most one
    fractional document per source, and nodes of ``FAN_IN`` combine these residuals level by level. Leaves and draws depend on
    rows and seed alone: reruns agree however the table is partitioned.

    Null text and text without words has size 0 and is taken 0 words. Null sources are one source, the last. Null ids and
    repeated rows are rows like any other. An empty table gives an empty result. Other columns are ignored.
    """
    out = _decided(docs, seed, id_col, text_col, source_col)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged; rows of size 0 stay once, they weigh nothing.

    A row is found by its id, source and text, not by its id alone. Rows equal in these are written and numbered, and the k-th is
    taken as often as the mix decided for the k-th, so exactly the decided number comes out.
    """
    chosen = _decided(docs, seed, id_col, text_col, source_col)
    chosen = materialise(chosen.select("g1", "g2", "j", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("copies")), "chosen")
    g1, g2, j, c1, c2, cj, each = fresh(docs, "g1", "g2", "j", "c1", "c2", "cj", "copies")
    doc_id, source, text = F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")
    marked = docs.withColumns(dict(zip((g1, g2), _names(doc_id, source, text), strict=True)))
    same = (F.col(g1) == F.col(c1)) & (F.col(g2) == F.col(c2))
    taken = chosen.select(F.col("g1").alias(c1), F.col("g2").alias(c2), F.col("j").alias(cj), F.col("copies").cast("int").alias(each))
    several = materialise(taken.filter(F.col(cj) > 0).select(c1, c2).distinct(), "several")
    d1, d2 = fresh(taken, "d1", "d2")
    once = taken.join(small(several.toDF(d1, d2)), (F.col(c1) == F.col(d1)) & (F.col(c2) == F.col(d2)), "left_anti")
    out = marked.join(small(materialise(once.filter(F.col(each) > 0), "once")), same)
    if not several.isEmpty():
        again = numbered(marked.join(small(several), same, "left_semi"), [g1, g2], j)
        out = out.unionByName(again.join(small(taken.filter(F.col(each) > 0)), same & (F.col(j) == F.col(cj))).drop(j))
    return out.withColumn(cj, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*quoted(docs.columns))
