"""Prefix trie of conversations: a distributed mergesort that carries longest common prefixes, and a stack of open nodes over the merged stream."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, materialise, small

#: Bytes of a turn's digest; a conversation is sorted as the digests of its turns, one after another.
DIGEST = 16
#: Conversations and bytes of one sorted run.
RUN_ROWS, RUN_BYTES = 20_000, 16 << 20
#: Conversations and bytes that one merge task is to hold.
MERGE_ROWS, MERGE_BYTES = 40_000, 32 << 20
#: Bytes of the ids that one row carries where a node's digest has to be put together from several tasks.
CHUNK = 1 << 16
#: Conversations share turns in families of so many ids, at most so many turns.
FAMILY, MOST_SHARED = 5, 9

_RUNS = "run long, ord long, lcp int, seq binary, sizes array<long>, conv_id long"
#: What a merge task gives: name, Spark's type, Arrow's type.
_NODES = (
    ("kind", "string", pa.string()), ("conv_id", "long", pa.int64()), ("depth", "int", pa.int32()), ("parent_conv_id", "long", pa.int64()), ("n_convs", "long", pa.int64()), ("n_children", "long", pa.int64()),
    ("n_leaves", "long", pa.int64()), ("saved_tokens", "decimal(38,0)", pa.decimal128(38, 0)), ("ends_sha256", "string", pa.string()), ("key", "binary", pa.binary()), ("parent_key", "binary", pa.binary()),
    ("bytes", "long", pa.int64()), ("part", "int", pa.int32()), ("side", "int", pa.int32()), ("chunk", "int", pa.int32()), ("ids", "string", pa.string()),
)
_SUMMED = tuple(f for f in _NODES if f[0] in ("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"))


def _schema(fields) -> str:
    return ", ".join(f"{n} {kind}" for n, kind, _ in fields)


def _batch(fields, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, _, kind in fields], names=[n for n, _, _ in fields])


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % MOST_SHARED


def slim_turns(turns: DataFrame) -> DataFrame:
    """(family, conv_id, turn, digest, bytes): role and text of a turn as a digest, with the bytes of its text. Rows without a conv_id
    belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)


@dataclass
class _Run:
    """Rebuilt conversations of one run."""

    rows: list = field(default_factory=list)
    size: int = 0

    def add(self, seq: bytes, conv_id: int, sizes: list[int]) -> None:
        self.rows.append((seq, conv_id, sizes))
        self.size += len(seq) * 2

    def full(self) -> bool:
        return len(self.rows) >= RUN_ROWS or self.size >= RUN_BYTES

    def batches(self, run: int) -> Iterator[pa.RecordBatch]:
        """The run in order, each row with the number of turns it has in common with the one before."""
        self.rows.sort(key=lambda r: r[:2])
        lcps = [0, *(common(a[0], b[0], 0) for a, b in zip(self.rows, self.rows[1:], strict=False))]
        for at in range(0, len(self.rows), 1000):
            part = self.rows[at : at + 1000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([run] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(lcps[at : at + len(part)], pa.int32()),
                    pa.array([r[0] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.list_(pa.int64())), pa.array([r[1] for r in part], pa.int64()),
                ],
                names=["run", "ord", "lcp", "seq", "sizes", "conv_id"],
            )


def common(a: bytes, b: bytes, known: int) -> int:
    """Leading turns that two sequences have in common, of which ``known`` need no look."""
    k, end = known, min(len(a), len(b)) // DIGEST
    while k < end and a[k * DIGEST : (k + 1) * DIGEST] == b[k * DIGEST : (k + 1) * DIGEST]:
        k += 1
    return k


def _form_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns, sorted by family, the family's first conversation, conversation and turn, to sorted runs of rebuilt conversations.

    Held at a time: a run, a conversation, and the turns that its family shares.
    """
    task, runs, run = TaskContext.get().partitionId(), 0, _Run()
    family: int | None = None
    head: list[tuple[bytes, int]] = []
    conv: int | None = None
    own: list[tuple[bytes, int]] = []

    def close() -> None:
        nonlocal head
        if conv is None:
            return
        if conv == family:
            head = own[: MOST_SHARED - 1]
        h = shared_turns(conv)
        whole = head[:h] + own[h:]
        run.add(b"".join(d for d, _ in whole), conv, [n for _, n in whole])

    for batch in batches:
        for f, c, digest, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if c != conv:
                close()
                if run.full():
                    yield from run.batches((task << 32) + runs)
                    runs, run = runs + 1, _Run()
                if f != family:
                    family, head = f, []
                conv, own = c, []
            own.append((digest, size))
    close()
    yield from run.batches((task << 32) + runs)


def sorted_runs(turns: DataFrame) -> DataFrame:
    """(run, ord, lcp, seq, sizes, conv_id): rebuilt conversations in sorted runs.

    Turns are shuffled once, by family, and sorted there by Spark (which spills); ties of a turn go by digest. A family is a few conversations.
    """
    slim = slim_turns(turns).repartition("family")
    first = F.col("conv_id") != F.col("family")
    return in_batches(slim.sortWithinPartitions("family", first, "conv_id", F.col("turn").asc_nulls_first(), "digest", "bytes").select("family", "conv_id", "digest", "bytes"), _form_runs, _RUNS)


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple[int, bytes, int, list[int]]]:
    """(lcp with the one before, seq, conv_id, sizes) in order, by a loser tree.

    ``runs``: sorted lists of (lcp, seq, conv_id, sizes). Every loser is kept with the turns it has in common with the winner it lost to. All losers
    on a winner's way up lost to that winner, so its successor meets them knowing what either shares with the last output: the one that shares
    more is smaller, and only where both share equally much are turns compared, from there on.
    """
    at, n = [1] * len(runs), 1
    while n < max(1, len(runs)):
        n *= 2
    head = [(0, *r[0][1:], k) if r else None for k, r in enumerate(runs)] + [None] * (n - len(runs))

    def match(a, b):
        """(winner, loser), the loser with what it shares with the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        shared = common(a[1], b[1], a[0])
        first, second = (a, b) if (a[1][shared * DIGEST :], a[2]) <= (b[1][shared * DIGEST :], b[2]) else (b, a)
        return first, (shared, *second[1:])

    losers: list = [None] * n
    level = head
    for size in (n >> k for k in range(1, n.bit_length())):
        met = [match(level[2 * k], level[2 * k + 1]) for k in range(size)]
        losers[size : 2 * size] = [m[1] for m in met]
        level = [m[0] for m in met]
    top = level[0]
    while top is not None:
        k = top[4]
        yield top[:4]
        top = None
        if at[k] < len(runs[k]):
            top = (*runs[k][at[k]], k)
            at[k] += 1
        node = (n + k) // 2
        while node:
            top, losers[node] = match(top, losers[node])
            node //= 2


@dataclass
class _Open:
    """A node on the path of the conversation just read."""

    key: bytes
    bytes: int
    conv_id: int
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    first_path: bool = False
    waiting: list = field(default_factory=list)
    ends: object = None
    text: list = field(default_factory=list)
    length: int = 0
    chunks: int = 0


def _stream_nodes(merged: Iterator[tuple[int, bytes, int, list[int]]], part: int) -> Iterator[dict]:
    """Nodes of one partition's slice of all conversations in order.

    Open nodes lie on a stack; a conversation that shares fewer turns with the one before closes the nodes below. Nodes on the way to the slice's first or last
    conversation may go on in other slices: they are given as ``edge`` rows with what is known here, and their ids as ``ends`` rows.
    Every other node is ``whole``. A whole node's children wait for nothing; those of an edge name its key, since its smallest conversation may lie elsewhere.
    """
    out: list[dict] = []
    stack: list[_Open] = []

    def flush(node: _Open) -> None:
        if node.text:
            out.append({"kind": "ends", "key": node.key, "part": part, "chunk": node.chunks, "ids": ",".join(node.text)})
            node.text, node.length, node.chunks = [], 0, node.chunks + 1

    def edge(node: _Open, depth: int, side: int, above: _Open | None) -> None:
        flush(node)
        out.append({
            "kind": "edge", "conv_id": node.conv_id, "depth": depth, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved,
            "key": node.key, "parent_key": above and above.key, "bytes": node.bytes, "part": part, "side": side,
        })

    def close(last: bool) -> None:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if above:
            above.n_convs += node.n_convs
            above.conv_id = min(above.conv_id, node.conv_id)
        if node.first_path or last:
            edge(node, depth, 0 if node.first_path else 1, above)
            return
        saved = node.saved + (node.n_convs - 1) * node.bytes
        leaves = node.n_leaves or 1
        row = {
            "kind": "whole", "conv_id": node.conv_id, "depth": depth, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": leaves, "saved_tokens": saved,
            "ends_sha256": (node.ends or hashlib.sha256()).hexdigest(),
        }
        above.n_children += 1
        above.n_leaves += leaves
        above.saved += saved
        if above.first_path:
            out.append(row | {"parent_key": above.key})
        else:  # the parent may still prove to lie on the last path
            above.waiting.append(row)
        for child in node.waiting:
            out.append(child | {"parent_conv_id": node.conv_id})

    for lcp, seq, conv_id, sizes in merged:
        while len(stack) > lcp + 1:
            close(False)
            if len(out) >= 1000:
                yield from out
                out.clear()
        first = not stack
        if first:
            stack.append(_Open(hashlib.sha256(b"").digest()[:DIGEST], 0, conv_id, first_path=True))
        while len(stack) <= len(sizes):
            k = len(stack) - 1
            stack.append(_Open(hashlib.sha256(stack[-1].key + seq[k * DIGEST : (k + 1) * DIGEST]).digest()[:DIGEST], sizes[k], conv_id, first_path=first))
        node = stack[-1]
        node.n_convs += 1
        node.conv_id = min(node.conv_id, conv_id)
        if node.ends is None:
            node.ends = hashlib.sha256()
        node.ends.update((f",{conv_id}" if node.length or node.chunks else f"{conv_id}").encode())
        node.text.append(str(conv_id))
        node.length += len(node.text[-1]) + 1
        if node.length >= CHUNK and node.first_path:
            flush(node)
    for node in stack:
        for child in node.waiting:
            out.append(child | {"parent_key": node.key})
        node.waiting = []
    while stack:
        close(True)
    yield from out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, lcp, seq, sizes, conv_id in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
            runs.setdefault(run, []).append((lcp, seq, conv_id, sizes))
    rows: list[dict] = []
    for row in _stream_nodes(merge_runs(list(runs.values())), TaskContext.get().partitionId()):
        rows.append(row)
        if len(rows) >= 1000:
            yield _batch(_NODES, rows)
            rows = []
    if rows:
        yield _batch(_NODES, rows)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes in the order of their paths: leaves and saved tokens of what lies below are added to each."""
    stack: list[dict] = []
    done: list[dict] = []
    fields = (*_SUMMED, ("parent_conv_id", "long", pa.int64()))

    def close() -> None:
        node = stack.pop()
        node["n_leaves"] = node["n_leaves"] or (0 if node["n_children"] else 1)
        done.append(node)
        if stack:
            node["parent_conv_id"] = stack[-1]["conv_id"]
            stack[-1]["n_leaves"] += node["n_leaves"]
            stack[-1]["saved_tokens"] += node["saved_tokens"]

    for batch in batches:
        for row in batch.to_pylist():
            while stack and stack[-1]["depth"] >= row["depth"]:
                close()
            stack.append(row)
        yield _batch(fields, done)
        done.clear()
    while stack:
        close()
    yield _batch(fields, done)


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids, sorted by node, slice and chunk, to one digest a node; nothing is held but the digest's state."""
    fields = (("end_key", "binary", pa.binary()), ("ends_sha256", "string", pa.string()))
    key, state, done = None, hashlib.sha256(), []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(f",{ids}".encode())
                continue
            if key is not None:
                done.append({"end_key": key, "ends_sha256": state.hexdigest()})
            key, state = k, hashlib.sha256(ids.encode())
        yield _batch(fields, done)
        done = []
    if key is not None:
        yield _batch(fields, [{"end_key": key, "ends_sha256": state.hexdigest()}])


def _long(c: Column) -> Column:
    return F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, turn, role, text. A conversation is its turns in order (null turn first), a null role or text being empty. Every conv_id c
    is rebuilt: the first h turns of conversation c - c % 5, then its own after its first h (h = crc32(c) % 9). A node is a distinct sequence of the first d
    rebuilt turns, its members the conversations that start with it.

    Sorted runs of rebuilt conversations carry what each shares with the one before. They are range-partitioned by (turns, conv_id), so
    that a group of equal conversations of any size is dealt over many tasks; each task merges its runs by a loser tree and emits
    finished nodes from the stack of open ones. Only the nodes on the way to a slice's first and last conversation can go on in
    another slice: two paths a task, which are summed by key and then added up along the path in one task (its rows grow with
    the number of tasks, not of conversations). Their ids pass as text chunks, in order, through a running digest.

    A turn is sorted as 16 bytes of a SHA-256; of turns with an equal number the smaller digest comes first, and a repeated row is a repeated turn. Rows with a null
    conv_id are left out. Conversations with no rebuilt turn are members of the root alone. ``saved_tokens`` above the longest long is
    given as that. A conversation is held whole as 24 bytes a turn. An empty table gives no rows, not even a root. Other columns are ignored.
    """
    runs = materialise(sorted_runs(turns), "runs")
    size = runs.agg(F.count("*"), F.sum(F.octet_length("seq") * 2)).first()
    cores = turns.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size[0] // MERGE_ROWS), -(-(size[1] or 0) // MERGE_BYTES), min(cores, size[0] // 1000))
    dealt = runs.repartitionByRange(tasks, "seq", "conv_id").sortWithinPartitions("run", "ord")
    found = materialise(in_batches(dealt, _merge, _schema(_NODES)), "nodes")

    edges = found.filter("kind = 'edge'")
    own = (F.sum("n_convs") - 1).cast("decimal(38,0)") * F.max("bytes")
    per = edges.groupBy("key").agg(
        F.min(F.struct("part", "side", "depth")).alias("at"), F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), (F.sum("saved_tokens") + own).cast("decimal(38,0)").alias("saved_tokens"),
    )
    kids = per.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("_above")).agg(F.count("*").alias("edge_children"))
    joined = per.join(kids, F.col("key") == F.col("_above"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0)))
    ordered = joined.repartition(1).sortWithinPartitions("at").select(*[n for n, _, _ in _SUMMED])  # two paths a task of the merge
    summed = materialise(in_batches(ordered, _add_up, _schema(_SUMMED) + ", parent_conv_id long"), "edges")
    chunks = found.filter("kind = 'ends'").select("key", "ids", "part", "chunk").repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "ids")
    digests = materialise(in_batches(chunks, _digest_ends, "end_key binary, ends_sha256 string"), "ends")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = found.filter("kind = 'whole'")
    under = whole.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(small(summed.select(F.col("key").alias("_key"), F.col("conv_id").alias("parent_conv_id"))), F.col("parent_key") == F.col("_key"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    last = summed.join(small(digests), F.col("key") == F.col("end_key"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    rows = whole.filter("parent_key IS NULL").select(columns).unionByName(under.select(columns)).unionByName(last.select(columns))
    return rows.select(*[(_long(F.col(c)) if c == "saved_tokens" else F.col(c).cast("long")).alias(c) if c != "ends_sha256" else F.col(c) for c in columns])


#: SQL of ``prefix_trie``. DuckDB has no crc32, so it is written out: a bit at a time over the decimal's digits.
ORACLE_SQL = """
    WITH ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
    crc AS (SELECT c, xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295), 4294967295) % 9 AS h FROM ids),
    own AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS b,
        sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS k FROM own),
    made AS (SELECT crc.c, 0 AS side, k, d, b FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND k < h UNION ALL SELECT crc.c, 1, k, d, b FROM crc JOIN t ON t.c = crc.c AND k >= h),
    seq AS (SELECT ids.c, coalesce(list(d ORDER BY side, k) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(b ORDER BY side, k) FILTER (d IS NOT NULL), []) AS bs FROM ids LEFT JOIN made ON made.c = ids.c GROUP BY ids.c),
    path AS (SELECT c, n, len(ds) AS whole, array_to_string(ds[1:n], '') AS key, CASE WHEN n > 0 THEN bs[n] ELSE 0 END AS b FROM seq, unnest(range(0, len(ds) + 1)) AS r(n)),
    node AS (SELECT key, n, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole = n), '')) AS ends_sha256 FROM path GROUP BY key, n),
    kids AS (SELECT key[: 64 * (n - 1)] AS key, count(*) AS n_children FROM node WHERE n > 0 GROUP BY 1),
    tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
    sums AS (SELECT key[: 64 * e] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens FROM tree, unnest(range(0, n + 1)) AS r(e) GROUP BY 1)
    SELECT a.conv_id, a.n AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
    FROM tree a JOIN sums USING (key) LEFT JOIN tree p ON a.n > 0 AND p.key = a.key[: 64 * (a.n - 1)]"""
