from itertools import combinations

import numpy as np

import corpus_pipeline
from weftline.llm.simhash import PAIRED, LongSimHash, candidates, most_bits, shingle_hashes, signatures, similar_documents

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def planted(rng):
    """Texts with edited copies (up to six words of 200), a chain whose ends differ, and a long line that all share."""
    words, rows = [f"w{i}" for i in range(3000)], []
    line = [f"l{i}" for i in range(20)]
    for _ in range(20):
        base = rng.choice(words, 200).tolist() + line
        for n in (0, 1, 2, 3, 4, 6):
            edit = list(base)
            for k in rng.choice(200, n, replace=False):
                edit[k] = "Edited"
            rows.append((len(rows), " ".join(edit)))
    chain = rng.choice(words, 300).tolist()
    for k in range(12):
        rows.append((len(rows), " ".join(chain[15 * k : 15 * k + 150])))
    return rows + [(len(rows) + k, t) for k, t in enumerate(["", None, " \t", "one", "ONE", "one two", "a b c d e", "a b c d e a b c d e"])]


def test_near_copies_against_brute_force(spark):
    rows = planted(np.random.default_rng(4))
    got = similar_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < 60 and len({want[i] for i in range(120, 132)}) == 1


def test_sample_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: r.component_id for r in similar_documents(docs).collect()} == brute([tuple(r) for r in docs.collect()])


def test_pipeline_stage_drops_planted_similar_documents(spark, sf):
    rows = planted(np.random.default_rng(5))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, sf)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(brute(rows).values()))


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "zz"), (5, "A b c d")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in similar_documents(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (5, 1)]
    assert similar_documents(df.filter("false")).count() == 0
    assert len(shingle_hashes("a b c d e f")) == 2 and len(shingle_hashes("a b")) == 1 and len(shingle_hashes(" ")) == 0


def test_packed_tables_give_every_pair_of_an_entry(spark):
    """Small blocks and many ranges of values: the pairs and crowded entries are those of the tables entry by entry."""
    rng = np.random.default_rng(8)
    rows = planted(rng)
    crowd = rng.choice([f"c{i}" for i in range(500)], 120).tolist()
    rows += [(1000 + k, " ".join([*crowd, f"own{k}"])) for k in range(30)] + [(2000 + k, rows[k][1]) for k in range(10)]
    hasher = LongSimHash(20, 14)
    prints = signatures(spark.createDataFrame(rows, SCHEMA).repartition(4), hasher).filter("n > 0").cache()
    got = candidates(prints, hasher, len(rows), 0.8, texts_a_task=20, block=25).collect()
    known = {r.key: r for r in prints.collect()}
    entries = {}
    for key, r in known.items():
        for s in range(20):
            value = ((r.lanes[s // 4] & (1 << 64) - 1) >> (s % 4 * 14)) & (1 << 14) - 1
            entries.setdefault(value | s << 14, []).append(key)

    def allowed(a, b):
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a.lanes[:2], b.lanes[:2], strict=True))
        return min(a.n, b.n) >= 0.8 * max(a.n, b.n) - 1e-9 and bits <= most_bits(128, 0.8)

    pairs = {(a, b) for held in entries.values() if len(held) <= PAIRED for a, b in combinations(sorted(held), 2) if allowed(known[a], known[b])}
    assert {(r.a, r.b) for r in got if r.place is None} == pairs and len(pairs) > 100
    assert sorted(r.place for r in got if r.place is not None) == sorted(p for p, held in entries.items() if len(held) > PAIRED)
    assert any(len(held) > PAIRED for held in entries.values())


def test_crowded_texts_ask_one_hub_each(spark, monkeypatch):
    """A large group of edited copies: pairs that are verified grow with its texts, not with texts times tables; components by brute force."""
    from weftline.llm import simhash

    rng = np.random.default_rng(3)
    base = rng.choice(2000, 300).astype(str)
    rows = []
    for i in range(400):
        words = base.copy()
        words[rng.integers(0, 300, 2)] = f"e{i}"
        rows.append((i, " ".join(words)))
    asked, links = [], simhash._links
    monkeypatch.setattr(simhash, "_links", lambda pairs, *a: asked.append(pairs.count()) or links(pairs, *a))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(asked) < 3 * len(rows)
    sets = [set(simhash.shingle_hashes(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= simhash.LEAST * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(rows))}


def test_crowded_texts_meet_their_entries_in_one_join(spark, monkeypatch):
    """Joins on table entries give about one row for each text and crowded entry that holds it, and twice as many for twice the group."""
    from weftline.llm import simhash

    base = np.random.default_rng(11).choice(2000, 300).astype(str)
    made, inner = [], type(spark.range(0)).join

    def join(self, other, on=None, how=None):
        out = inner(self, other, on, how)
        if "_place" in other.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(spark.range(0)), "join", join)
    total = []
    for size in (150, 300):
        made.clear()
        rng, rows = np.random.default_rng(12), []
        for i in range(size):
            words = base.copy()
            words[rng.integers(0, 300, 2)] = f"e{i}"
            rows.append((i, " ".join(words)))
        got = simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r.component_id for r in got} == {0}
        total.append(sum(made))
        assert max(made) > size and sum(made) < 1.5 * max(made)
    assert total[1] < 2.5 * total[0]
