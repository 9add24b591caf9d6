"""A dense search takes every query vector that is stated."""

import numpy as np

from weftline.operators import gram_index
from weftline.operators.retrieval import dense_block_scores
from weftline.queries import QUERIES


def test_dense_search_takes_every_hundredth_row(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()
    got = {r.query_id for r in QUERIES["srt2_ded5_udf2_dense_search"](spark, sf).collect()}
    assert got == {r.vec_id for r in rows if r.vec_id % 100 == 0} and len(got) > 1


def test_dense_blocks_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-3, 4, (300, 8)).astype(float)
    vectors[50:90] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(5)
    asked = docs.filter("doc_id % 10 = 0 OR doc_id = 999").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in dense_block_scores(asked, docs, 10, block=8).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = {q: sorted((-float(vectors[q] @ v), i) for i, v in enumerate(vectors))[:10] for q in range(0, 300, 10)}
    assert {q: sorted(x)[:10] for q, x in got.items()} == want


def test_both_searches_of_a_memo_share_one_index(spark, sf, monkeypatch):
    made, build = [], gram_index.build_index
    monkeypatch.setattr(gram_index, "build_index", lambda *a: made.append(a) or build(*a))
    rows = QUERIES["st3_memoised_retrieval"](spark, sf).collect()
    assert len(made) == 1 and {r.fresh for r in rows} == {True, False}
