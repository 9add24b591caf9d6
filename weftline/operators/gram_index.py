"""Inverted index of character n-grams: postings by block of documents with the largest weight of each gram, and an exact search that skips blocks
which cannot reach the candidate window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions import text as X
from weftline.sources.workspace import small, spread, store

SIZES = (2, 3, 4)
#: Documents and postings of one block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_POSTINGS = 512, 400_000
#: Postings that one task gathers before it sorts its documents and cuts them into blocks.
FORM_POSTINGS = 4_000_000
#: Queries that are scored against a block at a time.
QUERIES_AT_ONCE = 512
#: With fewer blocks than this to skip, all are scored at once: the same rows, without the passes that find out.
FEW_BLOCKS = 16
#: Products are held to this many decimals, so that equal documents tie in whatever order sums were made.
DECIMALS = 10
FEATURES = ("district", "unit", "doc_type")


def plain_text(text: Column) -> Column:
    """What grams are cut from: lower-cased words with single blanks between them."""
    return X.one_space(F.lower(text))


def gram_codes(text: str | None, sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the grams of ``plain_text``: windows of each size over the words, padded with a blank at either end, that span no
    blank. A gram's code is its characters in 16 bits each; grams with a character beyond the basic plane are mixed to 64 bits."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank, wide, found = s == 32, bool((s > 0xFFFF).any()), []
    for n in sizes:
        m = len(s) - n + 1
        if m <= 0:
            continue
        code, whole = np.zeros(m, np.uint64), np.ones(m, bool)
        for j in range(n):
            code |= (s[j : j + m] & np.uint64(0xFFFF)) << np.uint64(16 * j)
            if 0 < j < n - 1:
                whole &= ~blank[j : j + m]
        if wide:
            high = np.zeros(m, np.uint64)
            for j in range(n):
                high |= (s[j : j + m] >> np.uint64(16)) << np.uint64(16 * j)
            code = np.where(high > 0, _mixed(code ^ _mixed(high)), code)
        found.append(code[whole])
    return np.unique(np.concatenate(found).view(np.int64), return_counts=True) if found else gram_codes(None)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _check(sizes: Sequence[int]) -> None:
    """Sizes for which every padded word has a window of the first, and no word is cut at a size that a smaller one has used up."""
    if not sizes or list(sizes) != list(range(sizes[0], sizes[-1] + 1)) or sizes[0] > 3 or sizes[-1] > 4 or sizes[0] < 1:
        raise ValueError("sizes: consecutive, from 1, 2 or 3 to at most 4")


@dataclass(frozen=True)
class GramIndex:
    """Written tables. ``docs``: block, slot, doc_id, length (of the document's vector) and the features that boosts look at; ``postings``: block, key, slots, tfs; ``heads``: block, key, top (the
    largest tf / length); ``terms``: key, idf; ``blocks``: block, size and the features of its documents."""

    docs: DataFrame
    postings: DataFrame
    heads: DataFrame
    terms: DataFrame
    blocks: DataFrame
    sizes: tuple[int, ...]


def _form(sizes: Sequence[int], most: int):
    """Texts to postings, where they lie: a task's documents in order of district and length, so that a block's are alike and its bounds tight."""

    def cut(held: list) -> Iterator[list]:
        block, n = [], 0
        for doc in sorted(held, key=lambda h: (str(h[0]["district"]), len(h[1]), str(h[0]["doc_id"]))):
            if block and (len(block) >= most or n + len(doc[1]) > BLOCK_POSTINGS):
                yield block
                block, n = [], 0
            block.append(doc)
            n += len(doc[1])
        if block:
            yield block

    def batches_of(block: list, name: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        nulls = lambda n, skip: [pa.nulls(n, f.type) for f in schema if f.name not in skip]
        rows = [d[0] for d in block]
        given = [f.name for f in schema if f.name not in ("block", "slot", "key", "slots", "tfs")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), *nulls(len(rows), ("block", "slot", *given)), *[pa.array([r[g] for r in rows], schema.field(g).type) for g in given]], schema=schema
        )
        keys = np.concatenate([d[1] for d in block])
        order = np.argsort(keys, kind="stable")
        slots = np.repeat(np.arange(len(block), dtype=np.int32), [len(d[1]) for d in block])[order]
        tfs = np.concatenate([d[2] for d in block]).astype(np.int32)[order]
        starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1))
        ends = np.append(starts[1:], len(keys))
        for at in range(0, len(starts), 20_000):
            s, e = starts[at : at + 20_000], ends[at : at + 20_000]
            offsets = pa.array(np.append(s - s[0], e[-1] - s[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[s[0] : e[-1]])) for x in (slots, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), pa.int64()), pa.nulls(len(s), pa.int32()), pa.array(keys[order][s]), *lists, *[pa.nulls(len(s), schema.field(g).type) for g in given]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, schema = [], 0, TaskContext.get().partitionId() << 32, None

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made
            for block in cut(held):
                yield from batches_of(block, made, schema)
                made += 1
            held, size = [], 0

        for batch in batches:
            given = [f for f in batch.schema if f.name != "text"]
            schema = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("key", pa.int64()), ("slots", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), *given])
            columns = {f.name: batch.column(f.name).to_pylist() for f in batch.schema}
            for k in range(batch.num_rows):
                codes, counts = gram_codes(columns["text"][k], sizes)
                held.append(({f.name: columns[f.name][k] for f in given}, codes, counts))
                size += len(codes)
                if size >= FORM_POSTINGS:
                    yield from give()
        if held:
            yield from give()

    return run


def build_index(docs: DataFrame, text: Column, sizes: Sequence[int] = SIZES) -> GramIndex:
    """The index of ``docs`` (doc_id and, as far as there are, district, unit, doc_type, applicable_tags), cosine of smoothed TF-IDF: ln((1 + n) / (1 + df)) + 1.

    Texts are cut once, where they lie, and do not move; one row for each gram of a block is what is shuffled. A document without a gram has a row in
    ``docs`` and no posting.
    """
    _check(sizes)
    spark = docs.sparkSession
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in FEATURES}
    tags = F.col("applicable_tags").cast("array<string>") if "applicable_tags" in docs.columns else F.lit(None).cast("array<string>")
    slim = spread(docs.select("doc_id", plain_text(text).alias("text"), *[c.alias(n) for n, c in have.items()], tags.alias("applicable_tags")))
    kind = dict(slim.dtypes)["doc_id"]
    features = f"doc_id {kind}, district string, unit string, doc_type string, applicable_tags array<string>"
    formed = store(slim.mapInArrow(_form(tuple(sizes), BLOCK_DOCS), f"block long, slot int, key long, slots array<int>, tfs array<int>, {features}"), "formed")
    held, cut = formed.filter("slot IS NOT NULL"), formed.filter("key IS NOT NULL").select("block", "key", "slots", "tfs")
    n = held.count()
    terms = store(cut.groupBy("key").agg(F.sum(F.size("slots")).alias("df")).select("key", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "terms")
    each = cut.join(small(terms), "key").select("block", "idf", F.inline(F.arrays_zip("slots", "tfs")).alias("slot", "tf"))
    lengths = each.groupBy("block", "slot").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0)))).alias("length"))  # complete map-side: one task wrote a block
    rows = store(held.drop("key", "slots", "tfs").join(store(lengths, "lengths"), ["block", "slot"], "left").fillna({"length": 1.0}), "documents")
    arrays = store(rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "length")))["length"].alias("lengths")), "block_lengths")
    heads = cut.join(small(arrays), "block").select("block", "key", F.array_max(F.zip_with("slots", "tfs", lambda s, n: n / F.get("lengths", s))).alias("top"))
    sets = [F.collect_set(c).alias(f"{c}s") for c in FEATURES]
    blocks = held.groupBy("block").agg(F.count("*").alias("size"), *sets, F.array_distinct(F.flatten(F.collect_list(F.coalesce("applicable_tags", F.array().cast("array<string>"))))).alias("all_tags"))
    return GramIndex(rows, cut, store(heads, "heads"), terms, store(blocks, "blocks"), tuple(sizes))


def query_vectors(queries: DataFrame, text: Column, index: GramIndex) -> DataFrame:
    """(query_id, keys, weights): what a document's weights are multiplied with, of the grams that the index has; queries without one are
    absent. Queries stay distributed."""
    slim = spread(queries.select("query_id", plain_text(text).alias("text")))
    kind, sizes = dict(slim.dtypes)["query_id"], index.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                codes, counts = gram_codes(text, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(codes), pa.int64())), pa.array(codes), pa.array(counts.astype(np.int64))], names=["query_id", "key", "tf"])

    counted = slim.mapInArrow(run, f"query_id {kind}, key long, tf long")
    entry = F.struct("key", (F.col("tf") * F.col("idf") * F.col("idf")).alias("w"))
    square = F.pow(F.col("tf") * F.col("idf"), F.lit(2.0))
    per = counted.join(small(index.terms), "key").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.sqrt(F.sum(square)).alias("length"))
    return store(per.select("query_id", F.col("e.key").alias("keys"), F.transform("e.w", lambda w: w / F.col("length")).alias("weights")), "vectors")


def _products(_: tuple, asked: pa.Table, posted: pa.Table) -> pa.Table:
    """All products of a block with the queries that ask it, each query's in the order of its grams."""
    order = np.argsort(posted["key"].to_numpy(), kind="stable")
    keys, lists = posted["key"].to_numpy()[order], posted["slots"].combine_chunks()
    first, n = lists.offsets.to_numpy()[:-1][order], np.diff(lists.offsets.to_numpy())[order]
    slots, weights = lists.flatten().to_numpy(), posted["tfs"].combine_chunks().flatten().to_numpy().astype(np.float64)
    base, size = (lists.offsets[0].as_py(), int(slots.max()) + 1 if len(slots) else 0)
    first = first - base
    asked_keys, asked_weights = asked["keys"].combine_chunks(), asked["weights"].combine_chunks()
    rows, where, dots = [], [], []
    for k in range(asked.num_rows if len(keys) else 0):
        q, w = asked_keys[k].values.to_numpy(), asked_weights[k].values.to_numpy()
        at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
        hit = keys[at] == q
        at, w = at[hit], w[hit]
        if not len(at):
            continue
        flat = np.repeat(first[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
        total = np.bincount(slots[flat], weights=weights[flat] * np.repeat(w, n[at]), minlength=size)
        found = np.unique(slots[flat])
        rows.append(np.full(len(found), k))
        where.append(found)
        dots.append(total[found])
    pick = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
    some = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.empty(0, t))
    return pa.table({"query_id": asked["query_id"].combine_chunks().take(pick), "block": asked["block"].combine_chunks().take(pick), "slot": some(where, np.int32), "dot": some(dots, np.float64)})


def score_blocks(pairs: DataFrame, vectors: DataFrame, index: GramIndex, queries: int) -> DataFrame:
    """(query_id, score and the columns of ``index.docs``) of the documents that share a gram with a query, for the pairs (query_id, block). A block meets at most
    about ``QUERIES_AT_ONCE`` queries at a time."""
    kind = dict(vectors.dtypes)["query_id"]
    lot = F.pmod(F.xxhash64("query_id"), F.lit(queries // QUERIES_AT_ONCE + 1)).alias("lot")
    asked = small(pairs.select("query_id", "block")).join(small(vectors), "query_id").select("block", lot, "query_id", "keys", "weights")
    posted = index.postings.join(pairs.select("block", lot).distinct(), "block").select("block", "lot", "key", "slots", "tfs")
    dots = asked.groupBy("block", "lot").cogroup(posted.groupBy("block", "lot")).applyInArrow(_products, f"query_id {kind}, block long, slot int, dot double")
    return dots.join(small(index.docs), ["block", "slot"]).withColumn("score", F.round(F.col("dot") / F.col("length"), DECIMALS)).drop("dot", "length")


def bounds(vectors: DataFrame, index: GramIndex) -> DataFrame:
    """(query_id, block, bound): no document of the block has a higher score; blocks that share no gram with a query are absent."""
    entries = vectors.select("query_id", F.inline(F.arrays_zip("keys", "weights")).alias("key", "w"))
    return entries.join(small(index.heads), "key").groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))


def _block_boost(district: Column | None, tag: Column | None, unit: Column | None, types: Sequence[str]) -> Column:
    """The most that boosts can add to a document of a block."""
    b, out = rules.BOOSTS, F.lit(0.0)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    add = lambda test, value: F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))
    if district is not None:
        city = F.arrays_overlap("districts", F.array(*map(F.lit, rules.WHOLE_CITY)))
        out = out + add(given(district) & F.array_contains("districts", district), b["district"]) + add(given(district) & city, b["whole_city"])
    for column, name, value in ((tag, "all_tags", b["tag"]), (unit, "units", b["unit"])):
        if column is not None:
            out = out + add(given(column) & F.array_contains(name, column), value)
    return out + (add(F.arrays_overlap("doc_types", F.array(*map(F.lit, types))), b["doc_type"]) if types else F.lit(0.0))


def search_scores(queries: DataFrame, index: GramIndex, text: Column, boost: Column, least: Callable[[DataFrame], DataFrame], window: int, types: Sequence[str] = (), report: list | None = None) -> DataFrame:
    """(query_id, doc_id, score, base): of every query the documents that can be in its candidate window once boosts and matched terms are added, and
    perhaps others; ``base`` is the score with ``boost`` (a Column over the query's and the document's features).

    Of each query the blocks with the highest bounds are scored first, as many as hold ``window`` documents. ``least`` gives from these (query_id, doc_id, base) what a document has to reach
    (query_id, least; no row where anything may do). Blocks whose bound, with the most that boosts and matched terms can add, stays below
    are skipped. That is exact. ``report`` gets the numbers of pairs of query and block, and of those scored.
    """
    slack = rules.BOOSTS["most_terms"] + 1e-9
    given = {n: F.col(f"query_{n}") if f"query_{n}" in queries.columns else None for n in ("district", "tag", "unit")}
    known = queries.select("query_id", *[f"query_{n}" for n, c in given.items() if c is not None])
    vectors = query_vectors(queries, text, index)
    asked = vectors.count()

    def based(pairs: DataFrame, name: str) -> DataFrame:
        scored = score_blocks(pairs, vectors, index, asked).join(small(known), "query_id")
        return store(scored.select("query_id", "doc_id", "score", (F.col("score") + boost).alias("base")), name)

    names = [r.block for r in index.blocks.select("block").limit(FEW_BLOCKS).collect()]
    if len(names) < FEW_BLOCKS:
        return based(store(vectors.select("query_id", F.explode(F.array(*map(F.lit, names)).cast("array<bigint>")).alias("block")), "pairs"), "scored")
    reach = bounds(vectors, index).join(small(index.blocks), "block").join(small(known), "query_id")
    reach = store(reach.select("query_id", "block", (F.col("bound") + _block_boost(given["district"], given["tag"], given["unit"], types)).alias("bound"), "size"), "bounds")
    before = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    best = store(reach.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("before") < window).select("query_id", "block"), "best")
    first = based(best, "first")
    need = least(first.select("query_id", "doc_id", "base")).select(F.col("query_id").alias("_q"), "least")
    rest = reach.join(small(best), ["query_id", "block"], "left_anti").join(small(need), F.col("query_id") == F.col("_q"), "left")
    rest = store(rest.filter(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least"))).select("query_id", "block"), "rest")
    if report is not None:
        report += [reach.count(), best.count() + rest.count()]
    return first.unionByName(based(rest, "others"))


def all_scores(queries: DataFrame, index: GramIndex, text: Column) -> DataFrame:
    """(query_id, doc_id, score): every pair that shares a gram."""
    vectors = query_vectors(queries, text, index)
    pairs = store(bounds(vectors, index).select("query_id", "block"), "pairs")
    return score_blocks(pairs, vectors, index, vectors.count()).select("query_id", "doc_id", "score")
