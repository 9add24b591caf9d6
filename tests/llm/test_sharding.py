import zlib
from collections import Counter

import numpy as np

from weftline.llm.sharding import communication_matrix, hypergeometric, shard_sizes, shuffle_into_shards


def test_exact_sizes_slots_and_content(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    extra = spark.createDataFrame([(None, None), (9, ""), (9, ""), (10, "é" * 50_000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = shuffle_into_shards(rows, 40).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) <= set(range(40)) and max(sizes.values()) - min(sizes[k] for k in range(40)) <= 1
    for k in range(40):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert [tuple(r) for r in shuffle_into_shards(rows, 40).orderBy("shard", "slot").collect()] == sorted((tuple(r) for r in got), key=lambda r: (r[4], r[5]))


def test_fewer_rows_than_shards_and_none(spark):
    got = shuffle_into_shards(spark.createDataFrame([(i, "t") for i in range(3)], "doc_id long, text string"), 40).collect()
    assert len({r.shard for r in got}) == 3 and {r.slot for r in got} == {0}
    assert shuffle_into_shards(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_cells_cut_a_shard(spark, monkeypatch):
    monkeypatch.setattr("weftline.llm.sharding.ROWS_PER_CELL", 3)
    got = shuffle_into_shards(spark.range(500).selectExpr("id AS doc_id", "'same' AS text"), 7).collect()
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in enumerate(shard_sizes(500, 7)))


def test_matrix_margins_and_law():
    m = np.array(communication_matrix([5, 0, 100, 17], [40, 41, 41], 1))
    assert m.sum(1).tolist() == [5, 0, 100, 17] and m.sum(0).tolist() == [40, 41, 41] and (m >= 0).all()
    cells = np.array([communication_matrix([30, 30, 40], [50, 50], s)[0][0] for s in range(2000)])
    assert abs(cells.mean() - 15) < 0.3 and abs(cells.var() - 30 * 0.25 * 70 / 99) < 0.5


def test_large_draws_follow_the_law(monkeypatch):
    monkeypatch.setattr("weftline.llm.sharding._NUMPY_MOST", 0)
    rng = np.random.default_rng(0)
    x = np.array([hypergeometric(rng, 60, 140, 50) for _ in range(4000)])
    assert abs(x.mean() - 15) < 0.2 and abs(x.var() - 50 * 0.3 * 0.7 * 150 / 199) < 0.6
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 4, 0, 3) == 3


def test_draws_beyond_a_thousand_million(monkeypatch):
    """Means and variances of the law where numpy's sampler ends, and agreement with it just below."""
    rng, n = np.random.default_rng(1), 4000
    for good, bad, draws in ((3 * 10**9, 10**12, 10**6), (10**10, 4 * 10**11, 3 * 10**7), (5 * 10**9, 5 * 10**9, 4 * 10**9)):
        x, total = np.array([hypergeometric(rng, good, bad, draws) for _ in range(n if draws < 10**8 else 300)], float), good + bad
        mean, var = draws * good / total, draws * (good / total) * (bad / total) * (total - draws) / (total - 1)
        assert abs(x.mean() - mean) < 5 * (var / len(x)) ** 0.5 and 0.8 < x.var() / var < 1.25
    small = np.array([rng.hypergeometric(10**8, 8 * 10**8, 10**4) for _ in range(n)])
    monkeypatch.setattr("weftline.llm.sharding._NUMPY_MOST", 0)
    mine = np.array([hypergeometric(rng, 10**8, 8 * 10**8, 10**4) for _ in range(n)])
    assert np.abs(np.quantile(small, [0.05, 0.5, 0.95]) - np.quantile(mine, [0.05, 0.5, 0.95])).max() < 4


def test_law_of_a_small_table(spark):
    """Every row reaches every shard about equally often over seeds: the shuffle is uniform."""
    df = spark.range(12).selectExpr("id AS doc_id", "'t' AS text", "'x' AS shard", "1 AS slot").repartition(3).cache()
    seen = np.zeros((12, 3))
    for seed in range(25):
        for r in shuffle_into_shards(df, 3, seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert seen.sum() == 300 and np.abs(seen - 25 / 3).max() < 9
    df.unpersist()
