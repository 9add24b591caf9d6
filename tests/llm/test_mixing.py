import re
from collections import Counter, defaultdict

import numpy as np

from weftline.llm.mixing import mix, mixed_documents, numbered, pivotal_step, round_source, settle_large

SCHEMA = "doc_id long, text string, source string"


def targets(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**out, **share}, sizes
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= over
    return out, sizes


def check(rows, got, near=True):
    want, sizes = targets(rows)
    taken, largest = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        x = r.target / r.source_size if r.source_size else 0
        assert abs(r.copies - x) < 1 + 1e-6
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mix(docs).collect()
    check(rows, got)
    again = mix(docs.repartition(9)).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in again)


def test_tree_with_a_hot_source_and_nulls(spark, monkeypatch):
    monkeypatch.setattr("weftline.llm.mixing.ROWS_PER_LEAF", 20)
    monkeypatch.setattr("weftline.llm.mixing.FAN_IN", 3)
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), "hot" if i % 3 == 0 else [None, "a", "b", "é", "𝄞", "tiny"][min(5, i % 7)] if i % 7 < 5 or i < 20 else "a") for i in range(900)]
    rows += [(None, None, "a"), (None, "x y", None), (5, "p q r", "hot"), (5, "p q r", "hot")]
    check(rows, mix(spark.createDataFrame(rows, SCHEMA)).collect())


def test_all_empty_and_none(spark):
    rows = [(1, None, "a"), (2, "", None)]
    assert sorted(tuple(r) for r in mix(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, "a", 0, 0, 0.0, 0, 0), (2, None, 0, 0, 0.0, 0, 0)]
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_keep_words_and_expectation():
    rng = np.random.default_rng(0)
    ends = np.array([pivotal_step(0.3, 50, 0.6, 20, rng.random()) for _ in range(20_000)])
    assert np.allclose(ends @ [50, 20], 0.3 * 50 + 0.6 * 20)
    assert np.allclose(ends.mean(0), [0.3, 0.6], atol=0.01)
    assert ((np.abs(ends - np.rint(ends)) < 1e-9).any(1)).all()


def test_rounding_is_unbiased():
    sums = np.zeros(6)
    for s in range(4000):
        rng = np.random.default_rng(s)
        parts, held = round_source([9, 7, 5, 3, 2, 1], [0.4] * 6, rng)
        if held >= 0:
            parts[held] = float(rng.random() < parts[held])
        sums += parts
    assert np.allclose(sums / 4000, 0.4, atol=0.03)


def test_large_documents_are_settled_first():
    sizes, sums, kept = [900, 500, *[10] * 300], np.zeros(302), []
    for s in range(3000):
        parts = [0.4] * 302
        k = settle_large(sizes, parts, np.random.default_rng(s))
        assert k == 2 and set(parts[:2]) <= {0.0, 1.0} and abs(np.dot(sizes, parts) - 0.4 * sum(sizes)) < 1e-6
        sums += parts
        kept.append(parts[5])
    assert np.allclose(sums / 3000, 0.4, atol=0.03) and min(kept) > 0
    parts = [0.5, 0.5]
    assert settle_large([100, 3], parts, np.random.default_rng(0)) == 0 and parts == [0.5, 0.5]


def test_a_large_document_does_not_move_its_source_off_target(spark):
    rows = [(0, "w " * 20_000, "s"), (1, "t " * 20_000, "t")] + [(2 + i, "w " * 300, "s") for i in range(767)] + [(1000 + i, "t " * 90, "t") for i in range(3667)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in "st":
        target = next(r.target for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) / target - 1) < 0.005


def test_mixed_documents_take_effect(spark):
    rows = [(i, "a b c", "s" if i else "t") for i in range(40)] + [(99, "", "s"), (7, "a b c", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = Counter()
    for r in mix(df).collect():
        taken[r.doc_id] += 1 if r.size == 0 else r.copies
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +taken


def test_repeated_ids_come_out_as_often_as_decided(spark):
    rows = [(7, "a b c", "s")] * 6 + [(7, "a b c d", "s"), (7, "a b c d", "t"), (None, "x y", "s"), (None, "x y", "s"), (None, "x y", None), (8, "p q", "t"), (9, "", "t")]
    df = spark.createDataFrame([(*r, "1", 2, 3) for r in rows], "doc_id long, text string, source string, _copies string, _id int, _n int").repartition(5)
    decided = Counter()
    for r in mix(df).collect():
        decided[r.doc_id, r.source, r.size] += r.copies if r.size else 1
    for docs in (df, df.repartition(3)):
        out = mixed_documents(docs)
        assert out.columns == df.columns
        got = out.collect()
        assert Counter((r.doc_id, r.source, len(r.text.split())) for r in got) == +decided
        assert {(r._copies, r._id, r._n) for r in got} == {("1", 2, 3)}


def test_numbers_of_equal_rows_are_gapless(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(100)], "key long, x long").repartition(7)
    got = numbered(df, ["key"], "at").collect()
    assert len(got) == 100 and all(sorted(r["at"] for r in got if r.key == k) == list(range(sum(x % 3 == k for x in range(100)))) for k in range(3))


def test_a_hot_repeated_row_spreads_over_leaves(spark, monkeypatch):
    monkeypatch.setattr("weftline.llm.mixing.ROWS_PER_LEAF", 50)
    rows = [(1, "a b", "s")] * 300 + [(2 + k, "c d e", "t") for k in range(300)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)


def test_many_sources(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 9)) * (1 + 40 * (i % 97 == 0)), f"host{int(rng.integers(0, 200)):04d}") for i in range(700)]
    got = mix(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    check(rows, got)
