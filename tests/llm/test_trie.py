import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import trie as T
from weftline.llm.trie import merge_runs, prefix_trie, sorted_runs

SHAPE = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        first, h = c - (abs(c) % 5) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(first, [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(q[:-1] == x for q in below if q) for x in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((who[0], len(p), members[p[:-1]][0] if p else None, len(who), len(kids), leaves, saved, sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)


def odd_rows():
    draw = random.Random(11)
    texts = ["", None, "a", "ab", "ü", "a longer text"]
    rows = []
    for c in range(-30, 90):
        if c % 10 != 5:
            rows += [(c, draw.choice([None, *range(9)]), draw.choice(["user", None, "a"]), draw.choice(texts)) for _ in range(draw.randrange(1, 14))]
    rows += [(c, k, "user", f"turn {k}") for c in range(500, 800) for k in range(12)]  # equal conversations
    rows += [(c, 0, "user", "one turn") for c in range(1000, 1200)]
    rows += rows[:40] + [(None, 0, "user", "nobody's"), ((1 << 63) - 1, 0, "u", "v"), (-(1 << 63), 0, "u", "v")]
    return rows


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("most", [40_000, 90, 7])
def test_odd_rows_in_slices_of_any_size(spark, monkeypatch, most):
    rows = odd_rows()
    monkeypatch.setattr(T, "MERGE_ROWS", most)
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "'x' AS family", "1 AS digest", "2 AS depth", "'k' AS key")
    want = brute(rows)
    assert got(df) == want and len({(w[0], w[1]) for w in want}) == len(want)


def test_runs_hold_every_conversation_once(spark):
    rows = odd_rows()
    found = sorted_runs(spark.createDataFrame(rows, SHAPE)).collect()
    convs = rebuilt(rows)
    assert {r.conv_id: bytes(r.seq) for r in found} == {c: b"".join(digest(*t) for t in v) for c, v in convs.items()} and len(found) == len(convs)
    for run in {r.run for r in found}:
        part = sorted((r for r in found if r.run == run), key=lambda r: r.ord)
        assert [(bytes(r.seq), r.conv_id) for r in part] == sorted((bytes(r.seq), r.conv_id) for r in part)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("ab"), max_size=5), st.integers(0, 50)), max_size=8), max_size=9))
def test_loser_tree(lists):
    runs, every = [], []
    for one in lists:
        rows = sorted((b"".join(c.encode() * 16 for c in s), i) for s, i in one)
        lcps = [0, *(T.common(a[0], b[0], 0) for a, b in zip(rows, rows[1:], strict=False))]
        runs.append([(lcp, s, i, []) for lcp, (s, i) in zip(lcps, rows, strict=False)])
        every += rows
    out = list(merge_runs(runs))
    assert [(s, i) for _, s, i, _ in out] == sorted(every)
    assert [lcp for lcp, *_ in out] == [0 if k == 0 else T.common(out[k - 1][1], s, 0) for k, (_, s, _, _) in enumerate(out)]


def test_shared_turns_are_not_compared_again(monkeypatch):
    """Two runs of conversations that share 1000 turns: the merge compares about one turn for each conversation."""
    base = b"".join(digest("user", str(k)) for k in range(1000))
    seqs = sorted(base + digest("user", f"last {k}") for k in range(64))
    runs = [[(0 if k == 0 else 1000, s, 0, []) for k, s in enumerate(seqs[r::2])] for r in range(2)]
    looks, inner = [], T.common
    monkeypatch.setattr(T, "common", lambda a, b, known: looks.append(inner(a, b, known) - known) or inner(a, b, known))
    assert [s for _, s, _, _ in merge_runs(runs)] == seqs
    assert sum(looks) <= 1000 + 64


def test_one_long_conversation_and_one_without_turns(spark):
    rows = [(0, k, "user", f"t{k % 50}") for k in range(3000)] + [(c, 0, "user", "gone") for c in range(11, 15)]
    found = got(spark.createDataFrame(rows, SHAPE))
    convs = rebuilt(rows)
    assert len(found) == 1 + len({tuple(v[:d]) for v in convs.values() for d in range(1, len(v) + 1)})
    root = next(r for r in found if r[1] == 0)
    assert root[3] == len(convs) and any(not v for v in convs.values())
    assert root[7] == hashlib.sha256(",".join(str(c) for c in sorted(convs) if not convs[c]).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")]])
def test_empty(spark, rows):
    assert got(spark.createDataFrame(rows, SHAPE)) == []
