import math

import numpy as np
import pytest

from weftline.llm.ann import PROJECTIONS, SortedArrays, nearest_neighbours, projections, search_block

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every=50, k=5):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in fine:
        if q % every:
            continue
        score = {}
        for i, b in fine:
            if i != q and len(b) == len(a):
                score[i] = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
        out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("blocks", [64, 16384])
def test_recall_scores_and_ranks(spark, sf, monkeypatch, blocks):
    monkeypatch.setattr("weftline.llm.ann.BLOCK", blocks)
    monkeypatch.setattr("weftline.llm.ann.QUERIES", 4)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in rows.collect()]), found(nearest_neighbours(rows))
    assert set(got) == set(want) and all([r for r, *_ in v] == [1, 2, 3, 4, 5] for v in got.values())
    exact = {(q, i): s for q, v in brute([(r.vec_id, r.embedding) for r in rows.collect()], k=10**6).items() for i, s in v}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, v in got.items() for _, i, s in v)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_recall_over_a_large_block():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6000, 64))
    norms, ids = np.sqrt((v * v).sum(1)), np.arange(6000)
    d = projections(64, PROJECTIONS, 7)
    index, hits = SortedArrays(v / norms[:, None], d), 0
    for q in range(30):
        places, _ = search_block(index, v, norms, ids, v[q], q, d, 5, 37, 1.45)
        s = v @ v[q] / norms
        s[q] = -9
        hits += len(set(places) & set(np.argsort(-s)[:5]))
    assert hits >= 0.95 * 150


def test_hot_vector_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    hot = rng.standard_normal(8).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(400)] + [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(400, 600)]
    got = found(nearest_neighbours(spark.createDataFrame(rows, SCHEMA)))
    for q in range(0, 400, 50):
        assert [i for _, i, _ in got[q]] == [i for i in range(6) if i != q][:5]


def test_odd_vectors_few_candidates_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [3.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, []), (1, [3.0, 3.0]), (100, [0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")
    got = found(nearest_neighbours(df))
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {0: [1, 50], 50: [1, 0]}
    assert abs(got[0][0][2] - math.sqrt(0.5)) < 1e-15 and got[0][1][2] == 0
    assert nearest_neighbours(df.filter("false")).count() == 0


@pytest.mark.parametrize("block", [4, 16384])
def test_repeated_ids_do_not_crowd_others_out(spark, monkeypatch, block):
    monkeypatch.setattr("weftline.llm.ann.BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(7, (np.array([1.0, 0.1, 0, 0]) + rng.normal(0, 0.01, 4)).tolist()) for _ in range(8)] + [(101 + k, rng.normal(0, 1, 4).tolist()) for k in range(6)] + [(0, [1.0, 0.0, 0.0, 0.0])]
    got = found(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))[0]
    best = {}
    for i, v in rows[:-1]:
        best[i] = max(best.get(i, -9), v[0] / float(np.sqrt(np.dot(v, v))))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(i, round(s, 9)) for _, i, s in got] == [(i, round(s, 9)) for i, s in want]


def test_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 1e-300]), (4, [-1e300, 1e300])]
    got = found(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))[0]
    assert [i for _, i, _ in got] == [2, 1, 3, 4] and np.allclose([s for *_, s in got], [1, math.sqrt(0.5), 0, -math.sqrt(0.5)])
