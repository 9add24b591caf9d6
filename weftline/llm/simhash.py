"""SimHash near-duplicates by multi-index hashing: tables on fingerprint segments, small Hamming balls within a segment, and
verified complete distances."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftline.llm.common import by_group, ASCII_LOWER, fresh, give_back_heaps, in_batches, materialise, quoted, small
from weftline.llm.components import connected_components

SEED = 42
#: For each byte value its eight bits, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
_CHUNK = 1 << 12
#: Fingerprints whose probes one task makes (about 18 each), and the most such tasks.
CODES_PER_TASK, MOST_PARTS = 30_000, 20_000
#: A table entry of more fingerprints is not paired up; its fingerprints take the path of ``flip_links``.
CROWD = 64


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()  # splits at \x20 and \x09-\x0D


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of ``words`` (rows, lanes: uint64) have each bit, lowest bit of the first lane first."""
    wide = np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(len(words), -1)
    lanes = wide.shape[1]
    seen = np.bincount((wide + (np.arange(lanes, dtype=np.int64) * 256)).ravel(), minlength=lanes * 256).reshape(lanes, 256)
    return (seen.astype(np.float32) @ _BITS).ravel()  # exact: counts of a chunk are far below 2**24


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text: a bit is set if over half of the shingles' XXH64 have it.

    A text of fewer words is one shingle; a text without words has fingerprint zero.
    """
    tokens = _tokens(text)
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    n, total = len(starts), np.zeros(64)
    for at in range(0, n, _CHUNK):
        total += _bit_counts(np.array([[xxh64_intdigest(joined[a:b], SEED)] for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], np.uint64))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text); id and mark (a hash of the text) name a row's content."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as the signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return in_batches(_slim(docs, id_col, text_col).drop("mark"), run, "doc_id long, fp long")


#: Keys of a fingerprint in the tables of its two 32-bit segments. Of two codes within two bits either the upper segments
#: agree, or the lower ones differ in one bit at most. Hence the upper segment is looked up as it is, and the lower one with
#: its ball of radius one. Half a ball is enough: of two lower segments that differ in one bit one has it, and clears it.
_SEGMENT_KEYS = (
    "concat(array(shiftrightunsigned(fp, 32) | 4294967296L, fp & 4294967295L),"
    " transform(filter(sequence(0, 31), i -> (shiftright(fp, i) & 1) = 1), i -> (fp & 4294967295L) ^ shiftleft(1L, i)))"
)


def flip_links(prints: DataFrame) -> DataFrame:
    """(x, y): links that join all fingerprints (column fp) at two or fewer differing bits, without pairing up a group.

    The exact way for crowded table entries: each code and its 64 single-bit flips are keys on whole codes, and codes within
    two bits meet there. An entry holds which bits its codes flipped as one 64-bit mask, so it is combined map-side and stands for
    65 codes at most, however large the group; its codes are linked to one of them, after verification.
    """
    probes = prints.select(
        F.explode(
            F.expr(
                "array_append(transform(sequence(0, 63), i -> named_struct('code', fp ^ shiftleft(1L, i), 'mask', shiftleft(1L, i), 'self', 0)),"
                " named_struct('code', fp, 'mask', 0L, 'self', 1))"
            )
        ).alias("p")
    ).select("p.*")
    met = probes.groupBy("code").agg(F.expr("bit_or(mask)").alias("mask"), F.max("self").alias("self")).filter(F.bit_count("mask") + F.col("self") >= 2)
    codes = met.withColumn("codes", F.expr("transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1) = 1), i -> code ^ shiftleft(1L, i))"))
    hub = codes.withColumn("x", F.when(F.col("self") == 1, F.col("code")).otherwise(F.col("codes")[0]))
    return hub.select("x", F.explode("codes").alias("y")).filter((F.col("x") != F.col("y")) & (F.expr("bit_count(x ^ y)") <= 2)).distinct()


def hamming_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(x, y): links that join all distinct fingerprints (column fp) at two or fewer differing bits.

    Multi-index hashing: each code enters the tables of its segments and probes the small Hamming ball there (``_SEGMENT_KEYS``);
    codes that share an entry are candidates, and the distance of the complete codes decides. Nearly all entries hold one code or
    two, which the aggregation of the entries already gives as a pair. Larger ones are few; their codes are fetched again and paired,
    and beyond ``crowd`` codes go to ``flip_links`` instead, so nothing is paired within a large group and no link is lost.
    """
    places = prints.select("fp", F.explode(F.expr(_SEGMENT_KEYS)).alias("key"))
    entries = materialise(places.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).filter("n > 1"), "entries")
    near = F.expr("bit_count(x ^ y)") <= 2
    links = entries.filter(F.col("n") == 2).filter(near).select("x", "y")
    larger = materialise(entries.filter("n > 2").select(F.col("key").alias("_key"), F.col("n").alias("_n")), "larger")
    if larger.isEmpty():
        return links.distinct()
    held = materialise(places.join(small(larger), F.col("key") == F.col("_key")).select("key", "fp", "_n"), "held")
    few = held.filter(F.col("_n") <= crowd)
    pairs = few.select("key", F.col("fp").alias("x")).join(few.select(F.col("key").alias("_key"), F.col("fp").alias("y")), (F.col("key") == F.col("_key")) & (F.col("x") < F.col("y")))
    links = links.union(pairs.filter(near).select("x", "y"))
    many = held.filter(F.col("_n") > crowd).select("fp").distinct()
    return links.union(flip_links(many)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints link at two or fewer differing bits and components are transitive. Copies of a fingerprint are one node, so a
    group of any number of exact copies costs one probe set. Null text and text without words have fingerprint zero and
    are linked like any other. Repeated rows come out once each. A null doc_id takes part as a document but never names a
    component; a component of null ids only has a null component_id. An empty table gives an empty result. Other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    parts = min(MOST_PARTS, nodes.count() // CODES_PER_TASK + 1)
    links = materialise(hamming_links(nodes.select("fp").repartition(parts)), "links")
    final = _named(nodes.select(F.col("fp").alias("key"), "node"), links.toDF("a", "b"))
    return prints.join(small(final), F.col("fp") == F.col("_key")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(_key, root, component_id) of every node (key, node: its smallest id): a name of its component by the links (a, b), which is
    unique where ids repeat, and the smallest id in it."""
    groups = materialise(connected_components(links).toDF("_node", "_root"), "groups")
    rooted = materialise(nodes.join(small(groups), F.col("key") == F.col("_node"), "left").select("key", "node", F.coalesce("_root", "key").alias("root")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("node").alias("component_id")).withColumnRenamed("root", "_root"), "least")
    return materialise(rooted.join(small(least), F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), "root", "component_id"), "final")


# --- documents of similar shingle sets ---------------------------------------------------------------------------------------

#: Words of a shingle and the least Jaccard similarity of two texts' shingle sets that makes them near copies.
WORDS, LEAST = 5, 0.8
#: A pair at exactly that similarity is no candidate with this probability; it falls fast above it (1e-10 at 0.9).
MISS = 1e-4
#: Bits of a segment beyond the logarithm of the number of texts: unrelated texts rarely meet. At least, at most.
SPARE_BITS, LEAST_WIDTH, MOST_WIDTH = 2, 12, 31
#: Lanes of a fingerprint that are compared before its complete distance, and standard deviations that both bounds allow.
SKETCH, SIGMAS = 2, 6.0
#: Words whose hashes a worker keeps.
CACHED = 200_000
_PLACES = np.random.default_rng(SEED + 1).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def bit_difference(least: float) -> float:
    """The probability that a bit differs in the SimHashes of two sets of one size and that Jaccard similarity (sets of unequal
    size are nearer): their indicator vectors enclose an angle of cosine 2 J / (1 + J)."""
    return math.acos(2 * least / (1 + least)) / math.pi


def layout(texts: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(segments, bits of each) for so many texts: a segment agrees with probability (1 - p) ** bits."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, max(1, texts - 1).bit_length() + SPARE_BITS))
    agree = (1 - bit_difference(least)) ** width
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1, width


def most_bits(bits: int, least: float) -> int:
    """The complete distance up to which two fingerprints can belong to sets of that similarity."""
    p = bit_difference(least)
    return min(bits, math.floor(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)) + 1))


def shingle_hashes(text: str | None, words: int = WORDS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted. A text of fewer words is one shingle; one without words has none."""
    tokens = _tokens(text)
    if not tokens:
        return np.empty(0, np.uint64)
    known = {} if known is None else known
    codes = list(map(known.get, tokens))
    if None in codes:
        if len(known) > CACHED:
            known.clear()
        for k in [k for k, c in enumerate(codes) if c is None]:
            codes[k] = known[tokens[k]] = xxh64_intdigest(tokens[k], SEED)
    code, width = np.array(codes, np.uint64), min(words, len(tokens))
    n = len(code) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed += code[k : k + n] * _PLACES[k]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(times)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def set_key(hashes: np.ndarray) -> int:
    """Unsigned 64-bit name of a shingle set; the empty set is zero."""
    return xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


class LongSimHash:
    """Fingerprints of several 64-bit lanes, each with as many whole segments as it holds; a lane mixes each shingle's hash with a
    key of its own."""

    def __init__(self, segments: int, width: int) -> None:
        self.segments, self.width, self.per_lane = segments, width, 64 // width
        self.lanes = max(SKETCH, -(-segments // self.per_lane))
        keys = np.random.default_rng(SEED).integers(1, 1 << 64, (2, self.lanes), np.uint64, endpoint=False)
        self._xor, self._times = keys[0], keys[1] | np.uint64(1)
        self._rows = max(1, (1 << 20) // (8 * self.lanes))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The lanes as signed longs."""
        total = np.zeros(64 * self.lanes)
        for at in range(0, len(hashes), self._rows):
            x = (hashes[at : at + self._rows, None] ^ self._xor) * self._times
            total += _bit_counts(x ^ (x >> np.uint64(32)))
        return np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")

    def segment(self, lanes: np.ndarray, number: int) -> np.ndarray:
        """The values of one segment in rows of unsigned lanes."""
        shift = np.uint64(number % self.per_lane * self.width)
        return (lanes[:, number // self.per_lane] >> shift) & np.uint64((1 << self.width) - 1)

    def places(self, lanes: str) -> Column:
        """Table keys of a column of lanes: each segment's number and value."""
        lane, shift, mask = f"cast(s div {self.per_lane} AS int)", f"cast(s % {self.per_lane} * {self.width} AS int)", (1 << self.width) - 1
        return F.expr(f"transform(sequence(0, {self.segments - 1}), s -> (shiftrightunsigned({lanes}[{lane}], {shift}) & {mask}L) | shiftleft(cast(s AS bigint), {self.width}))")


def signatures(docs: DataFrame, hasher: LongSimHash, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, mark, key, n, lanes) of every whole text: its shingle set's name, size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), words, known) for x in batch.column(2)]
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            columns = [pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array([hasher.of(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "mark", "key", "n", "lanes"])

    return in_batches(_slim(docs, id_col, text_col), run, "doc_id long, mark long, key long, n long, lanes array<long>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(key, hashes) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), words, known) for x in batch.column(1)]
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "hashes"])

    return in_batches(_slim(docs, id_col, text_col).drop("mark"), run, "key long, hashes array<long>")


def _distance(a: str, b: str) -> Column:
    """Differing bits of two arrays of lanes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _close(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose sizes and first lanes allow the similarity, each once."""
    one, two = (small(nodes.select(F.col("key").alias(f"_{c}"), F.col("n").alias(f"_n{c}"), F.col("head").alias(f"_h{c}"))) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    sizes = F.least("_na", "_nb") >= F.lit(least) * F.greatest("_na", "_nb") - 1e-9
    return both.filter(sizes & (_distance("_ha", "_hb") <= most_bits(64 * SKETCH, least))).select("a", "b").distinct()


def _links(pairs: DataFrame, wanted: DataFrame, bits: int, least: float) -> DataFrame:
    """``pairs`` (a, b) of sets that have the similarity: by the complete distance, then exactly. ``wanted``: key, lanes, hashes."""
    far = _distance("_al", "_bl") > most_bits(bits, least)
    one, two = (wanted.select(F.col("key").alias(f"_{c}"), F.col("lanes").alias(f"_{c}l"), F.col("hashes").alias(f"_{c}s")) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).filter(~far).withColumn("_common", F.size(F.array_intersect("_as", "_bs")))
    return both.filter(F.col("_common") >= F.lit(least) * (F.size("_as") + F.size("_bs") - F.col("_common")) - 1e-9).select("a", "b")


def _across(wanted: DataFrame, rest: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of different groups of ``rest`` (_key, _group) that can have the similarity, each once; none that has it is left out.

    A text's shingles are put in one order for all, rarest first. Of two texts that have the similarity the first shingle they share is
    followed, in either, by all others they share, so it stands early enough in both. Edited copies of one text and texts around one
    passage begin with what few others hold; so they seldom meet, where their fingerprints always do.
    """
    shingles = wanted.join(small(rest), F.col("key") == F.col("_key")).select("key", F.col("_group").alias("group"), F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    held = shingles.groupBy("hash").agg(F.count("*").alias("_held"), (F.min("group") != F.max("group")).alias("_shared"))
    held = materialise(held.filter("_held > 1").withColumnRenamed("hash", "_hash"), "held")
    order = Window.partitionBy("key").orderBy(F.coalesce("_held", F.lit(1)), "hash")
    places = shingles.join(small(held), F.col("hash") == F.col("_hash"), "left").withColumn("left", F.col("n") - F.row_number().over(order) + 1)
    early = materialise(places.filter(F.col("_shared") & (F.col("left") >= F.lit(least) * F.col("n") - 1e-6)).select("hash", "key", "group", "n", "left"), "early")
    other = early.select(*[F.col(c).alias(f"_{c}") for c in early.columns])
    sizes = (F.col("n") >= F.lit(least) * F.col("_n") - 1e-6) & ((F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("key") < F.col("_key"))))
    common = F.least("left", "_left") >= F.lit(least / (1 + least)) * (F.col("n") + F.col("_n")) - 1e-6
    met = early.join(other, (F.col("hash") == F.col("_hash")) & (F.col("group") != F.col("_group")) & sizes & common)
    return met.select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()


#: Texts of a table entry that are paired up; in a larger one all are compared with one of them first.
PAIRED = 8
#: Largest entries of a text whose hubs it may be compared with.
HUBS = 4
#: Segments whose tables one task holds, texts it holds of them, and texts of one message to it.
SEGMENTS_A_TASK, TEXTS_A_TASK, TEXTS_A_BLOCK = 16, 1 << 17, 1 << 14
#: Lots of tables that are made one after the other, so that the entries of one lot alone are on disk.
LOTS = 4
_BLOCK = "slot long, keys binary, sizes binary, heads binary, rows binary, entries binary, counts binary"


def _rank_in_run(ordered: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value of a sorted array."""
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
    at = np.arange(len(ordered))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _blocks(prints: DataFrame, hasher: LongSimHash, ranges: int, block: int, lot: int = 0, lots: int = 1) -> DataFrame:
    """Table entries on their way to tasks, packed by block of texts: a task (slot) holds ``SEGMENTS_A_TASK`` segments and one of
    ``ranges`` ranges of their values, and gets each text's name, size and first lanes once beside its entries there. Of one entry a block
    sends one text more than are paired up, which is enough to tell that it is crowded."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def pack(keys: np.ndarray, sizes: np.ndarray, lanes: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, one = np.unique(keys, return_index=True)
        sizes, lanes = sizes[one].astype("<i4"), lanes[one]
        for group in range(lot, -(-hasher.segments // SEGMENTS_A_TASK), lots):
            start = group * SEGMENTS_A_TASK
            parts = []
            for s in range(start, min(start + SEGMENTS_A_TASK, hasher.segments)):
                values = hasher.segment(lanes, s)
                order = np.argsort(values, kind="stable")
                order = order[_rank_in_run(values[order]) <= PAIRED]
                parts.append((np.full(len(order), s - start), order, values[order]))
            segment, row, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            slot = (value * np.uint64(ranges)) >> np.uint64(hasher.width)
            order = np.argsort(slot, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
                used, at = np.unique(row[mine], return_inverse=True)
                counts = np.bincount(segment[mine], minlength=SEGMENTS_A_TASK)
                packed = [keys[used], sizes[used], lanes[used, :SKETCH], at.astype("<u4"), value[mine].astype("<u4"), counts.astype("<u4")]
                columns = [pa.array([group * ranges + int(slot[mine[0]])], pa.int64()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in packed]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                lanes = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, hasher.lanes)
                waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lanes))
            if sum(len(w[0]) for w in waiting) >= block:
                yield from pack(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting = []
        if waiting:
            yield from pack(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return in_batches(prints.filter("n > 0").select("key", "n", "lanes"), run, _BLOCK)


def candidates(prints: DataFrame, hasher: LongSimHash, texts: int, least: float, texts_a_task: int = TEXTS_A_TASK, block: int = TEXTS_A_BLOCK, lot: int = 0, lots: int = 1) -> DataFrame:
    """(a, b, place, crowd) of ``prints`` (key, n, lanes): pairs that share an entry and whose sizes and first lanes allow the similarity,
    with a null place; and, with null keys, the places of entries of over ``PAIRED`` keys, which are not paired up here, and how
    many keys were sent of each.

    An entry travels as a value and a row number (8 bytes), and a text's name, size and first lanes once for ``SEGMENTS_A_TASK``
    of its segments. The values of a segment are dealt over more tasks as the number of ``texts`` grows, so that a task's share stays. Only every ``lots``-th task, from ``lot``, has its segments looked up.
    """
    ranges = -(-max(1, texts) // texts_a_task)
    allowed, width = most_bits(64 * SKETCH, least), np.uint64(hasher.width)

    def meet(table: pa.Table) -> pa.Table:
        def column(name: str, dtype: str) -> list[np.ndarray]:
            return [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]

        first = table.column("slot")[0].as_py() // ranges * SEGMENTS_A_TASK
        held = column("keys", "<i8")
        keys, one, node = np.unique(np.concatenate(held), return_index=True, return_inverse=True)
        sizes, heads = np.concatenate(column("sizes", "<i4"))[one], np.concatenate(column("heads", "<u8")).reshape(-1, SKETCH)[one]
        offsets = np.cumsum([0, *map(len, held)])
        rows = [r.astype(np.int64) + o for r, o in zip(column("rows", "<u4"), offsets[:-1], strict=True)]
        values, counts = column("entries", "<u4"), column("counts", "<u4")
        ends = [np.cumsum([0, *c.tolist()]) for c in counts]
        found, crowded, held_there = [], [], []
        for k in range(SEGMENTS_A_TASK):
            mine = [(values[b][e[k] : e[k + 1]], rows[b][e[k] : e[k + 1]]) for b, e in enumerate(ends)]
            value, row = (np.concatenate(x) for x in zip(*mine, strict=True))
            if not len(value):
                continue
            entry = np.unique((value.astype(np.uint64) << np.uint64(32)) | node[row].astype(np.uint64))
            value, text = entry >> np.uint64(32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64)
            each, at, run = np.unique(value, return_inverse=True, return_counts=True)
            paired = run[at] <= PAIRED
            crowded.append(each[run > PAIRED] | (np.uint64(first + k) << width))
            held_there.append(run[run > PAIRED])
            value, text = value[paired], text[paired]
            for gap in range(1, PAIRED):
                same = np.flatnonzero(value[gap:] == value[:-gap])
                a, b = text[same], text[same + gap]
                small_n, large_n = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                near = (small_n >= least * large_n - 1e-9) & (np.bitwise_count(heads[a] ^ heads[b]).sum(axis=1) <= allowed)
                found.append((a[near] << 32) | b[near])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        places = np.concatenate(crowded).view(np.int64) if crowded else np.empty(0, np.int64)
        nothing = [pa.nulls(len(places), pa.int64())]
        a, b = (pa.chunked_array([pa.array(keys[x]), *nothing]) for x in (pairs >> 32, pairs & 0xFFFFFFFF))
        place, crowd = (pa.chunked_array([pa.nulls(len(pairs), pa.int64()), pa.array(x, pa.int64())]) for x in (places, np.concatenate([*held_there, places[:0]])))
        return pa.table({"a": a, "b": b, "place": place, "crowd": crowd})

    return _blocks(prints, hasher, ranges, block, lot, lots).groupBy("slot").applyInArrow(by_group(meet), "a long, b long, place long, crowd long")


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(doc_id, mark, root, component_id) of every row; see ``similar_documents``."""
    hasher = LongSimHash(*layout(docs.count(), least))
    prints = materialise(signatures(docs, hasher, id_col, text_col, words), "signatures")
    nodes = prints.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *[F.first(F.col("lanes")[k]).alias(f"h{k}") for k in range(SKETCH)])
    nodes = materialise(nodes.select("key", "node", "n", F.array(*[f"h{k}" for k in range(SKETCH)]).alias("head")), "nodes")
    many_texts = nodes.count()
    met = reduce(DataFrame.union, [materialise(candidates(prints, hasher, many_texts, least, lot=lot, lots=LOTS), "met") for lot in range(LOTS)])
    pairs = materialise(met.filter("place IS NULL").select("a", "b").distinct(), "pairs")
    crowds = materialise(met.filter("place IS NOT NULL").select(F.col("place").alias("_place"), "crowd"), "crowds")
    give_back_heaps(docs.sparkSession)  # what the tables left
    # One row for each text of crowded entries, with all of them; texts meet entries in this one join, in proportion to their number.
    places = prints.filter("n > 0").select("key", F.explode(hasher.places("lanes")).alias("place"))
    held = places.join(small(crowds), F.col("place") == F.col("_place")).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("crowd", "place")), asc=False).alias("held"))
    company = F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + x["crowd"])
    many = materialise(held.select("key", company.alias("company"), F.col("held.place").alias("places")), "many")
    # Of a crowded entry's texts the one that shares most and largest entries is its hub; a text is compared with the foremost hub of its largest entries.
    hubs = many.select("key", "company", F.explode("places").alias("_place")).groupBy("_place").agg(F.max(F.struct("company", "key")).alias("hub"))
    asked = many.select("key", F.explode(F.slice("places", 1, HUBS)).alias("place"))
    star = asked.join(small(materialise(hubs, "hubs")), F.col("place") == F.col("_place")).filter(F.col("key") != F.col("hub.key")).groupBy("key").agg(F.max("hub").alias("hub"))
    star = star.select(F.least("hub.key", "key").alias("a"), F.greatest("hub.key", "key").alias("b"))
    # One pair of each text comes first; of the others only those are compared that could still join two components.
    first = materialise(_close(star.distinct(), nodes, least).union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), "first")

    keys = materialise(pairs.select(F.col("a").alias("_key")).union(pairs.select("b")).union(many.select("key")).distinct(), "wanted")
    texts = shingle_sets(docs, id_col, text_col, words).join(small(keys), F.col("key") == F.col("_key"), "left_semi").dropDuplicates(["key"])
    lanes = prints.select(F.col("key").alias("_k"), "lanes").join(small(keys), F.col("_k") == F.col("_key"), "left_semi").dropDuplicates(["_k"])
    wanted = materialise(texts.join(lanes, F.col("key") == F.col("_k")).select("key", "lanes", "hashes"), "sets")
    give_back_heaps(docs.sparkSession)
    bits = 64 * hasher.lanes
    groups = materialise(connected_components(materialise(_links(first, wanted, bits, least), "links")).toDF("_node", "_group"), "groups")
    of_a, of_b = (small(groups.toDF(f"_{c}", f"_g{c}")) for c in "ab")
    apart = pairs.join(of_a, F.col("a") == F.col("_a"), "left").join(of_b, F.col("b") == F.col("_b"), "left").filter(F.coalesce("_ga", "a") != F.coalesce("_gb", "b"))
    apart = materialise(apart.select("a", "b").join(first.toDF("_a", "_b"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), "apart")
    links = materialise(_links(apart, wanted, bits, least).union(groups.select("_node", "_group")), "links")

    # What is in one component by now is connected; the rest of a crowded entry is compared across components, without a bound.
    groups = materialise(connected_components(links).toDF("_node", "_group"), "groups")
    grouped = materialise(many.join(small(groups), F.col("key") == F.col("_node"), "left").select("key", F.coalesce("_group", "key").alias("group"), "places"), "grouped")
    spread = grouped.select("key", "group", F.explode("places").alias("place"))
    split = spread.groupBy("place").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).filter("_low != _high").select(F.col("place").alias("_place"))
    rest = spread.join(small(materialise(split, "split")), F.col("place") == F.col("_place"), "left_semi").select("key", "group").distinct()
    rest = materialise(rest.withColumnsRenamed({"key": "_key", "group": "_group"}), "rest")
    links = groups.select(F.col("_node").alias("a"), F.col("_group").alias("b"))  # the components found so far, by one link a text
    if not rest.isEmpty():
        links = links.union(_links(materialise(_across(wanted, rest, least), "pairs"), wanted, bits, least))
    final = _named(nodes.select("key", "node"), links)
    return prints.select("doc_id", "mark", "key").join(small(final), F.col("key") == F.col("_key")).select("doc_id", "mark", "root", "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of every document: the smallest doc_id reachable over near copies.

    Documents are near copies if their sets of ``words``-word shingles have a Jaccard similarity of ``least`` and more; components
    are transitive. Equal sets are one node, and all texts without words are one. 64 bits do not reach a similarity of 0.8 (such
    pairs differ in about ten bits, some in twenty), so the fingerprint is longer here: ``layout`` gives as many segments as
    leave a pair at ``least`` without a common one with probability ``MISS``, each wide enough that unrelated texts seldom meet.
    Candidates are verified by the complete distance and then by the exact similarity.

    A text of fewer words is one shingle. Repeated rows come out once each; a null doc_id takes part but names no component. An
    empty table gives an empty result. Other columns are ignored.
    """
    return _similar(docs, id_col, text_col, words, least).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each component of ``similar_documents``, columns unchanged.

    The document with the component's smallest id stays; if several texts of the component have that id, the one with the
    smallest hash of its text. Repeats of the row that stays (one id, one text) stay with it. A row goes only for its own id and text:
    other texts under an id that goes are not touched. Rows with a null id stay.
    """
    found = materialise(_similar(docs, id_col, text_col, words, least).filter("doc_id IS NOT NULL"), "found")
    stays = materialise(found.groupBy("root").agg(F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("mark"))).alias("_least")).withColumnRenamed("root", "_root"), "stays")
    judged = found.join(small(stays), F.col("root") == F.col("_root"))
    gone_id, gone_mark, mark = fresh(docs, "gone", "gone_mark", "mark")
    gone = judged.filter((F.col("doc_id") != F.col("component_id")) | (F.col("mark") != F.col("_least"))).select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    return marked.join(small(materialise(gone, "gone")), (F.col(id_col) == F.col(gone_id)) & (F.col(mark) == F.col(gone_mark)), "left_anti").select(*quoted(docs.columns))
