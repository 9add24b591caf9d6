"""The index gives what scoring every pair gives, and skips blocks that cannot matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import corpus, gram_index, retrieval

SHAPE = "doc_id long, title string, content string, district string, source string, doc_type string, unit string, applicable_tags array<string>"


def rows():
    draw = random.Random(2)
    tongues = [["stone", "river", "bridge", "water", "light"], ["straße", "brücke", "wasser", "licht", "über"], ["路灯", "噪声扰民", "停车", "物业", "😀 wide 😀"], ["eau", "pierre", "lumière", "pont", "x"]]
    out = []
    for k in range(400):
        tongue = draw.randrange(4)
        words = " ".join(draw.choice(tongues[tongue]) for _ in range(draw.randrange(0, 40)))
        out.append((k, f"t{k % 90}", words if k % 7 else "stone river", ["d0", "d1", "全市", None][tongue], f"s{k % 3}", ["案例", "法规"][k % 2], f"u{k % 5}", [f"g{k % 4}"]))
    out += [(1000, "only a title", "", "d0", "s", "案例", "u", None), (1001, "", None, None, None, None, None, None)]
    return out


def asked(spark):
    given = [(1, "stone bridge over the river", "d0", "g1", "u2"), (2, "brücke über wasser", None, "", None), (3, "路灯 噪声扰民", "d1", None, "u1"), (4, "", "d0", "g1", "u1"), (5, None, "d0", None, None), (6, "qqq zzz", "d0", "g2", "u2"), (7, "😀", "全市", "g3", "u3")]
    return spark.createDataFrame(given, "query_id int, query string, query_district string, query_tag string, query_unit string")


def found(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 4), tuple(r.matched_terms)) for r in df.collect())


@pytest.mark.parametrize(("most", "types"), [(512, ()), (16, ()), (16, ("法规",)), (3, ())])
def test_blocks_of_any_size_give_what_all_pairs_give(spark, monkeypatch, most, types):
    docs, queries = corpus.normalised(spark.createDataFrame(rows(), SHAPE)), asked(spark)
    want = found(retrieval.search(queries, docs, retrieval.tfidf_scores(queries, docs.withColumn("_w", X.document_text()), F.col("query"), F.col("_w")), 3, types))
    monkeypatch.setattr(gram_index, "FEW_BLOCKS", 0)
    monkeypatch.setattr(gram_index, "QUERIES_AT_ONCE", 2)
    report = []
    inner = gram_index._form
    monkeypatch.setattr(gram_index, "_form", lambda sizes, docs_a_block: inner(sizes, most))
    got = found(retrieval.tfidf_search(queries, docs, gram_index.build_index(docs, X.document_text()), 3, types, report))
    assert got == want and {g[0] for g in got} == {1, 2, 3, 7}
    assert report[1] <= report[0] and (most > 16 or report[1] < 0.9 * report[0])


def test_bounds_hold_for_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("district"))
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = gram_index.build_index(docs, F.col("text"))
    vectors = gram_index.query_vectors(queries, F.col("text"), index)
    most = {(r.query_id, r.block): r.bound for r in gram_index.bounds(vectors, index).collect()}
    pairs = gram_index.bounds(vectors, index).select("query_id", "block").collect()
    scored = gram_index.score_blocks(spark.createDataFrame(pairs), vectors, index, 10_000).collect()
    assert scored and all(r.score <= most[r.query_id, r.block] + 1e-9 for r in scored)
    assert {(r.query_id, r.block) for r in scored} == set(most)


def test_equal_documents_tie_and_lengths_are_one(spark):
    docs = spark.createDataFrame([(k, "the same text of some words" if k % 3 else f"another {k}", "d") for k in range(60)], "doc_id long, text string, district string").repartition(5)
    queries = spark.createDataFrame([(1, "some words of the text")], "query_id int, query string")
    scores = {}
    for r in retrieval.tfidf_scores(queries, docs, F.col("query"), F.col("text")).collect():
        scores.setdefault(r.doc_id % 3 > 0, set()).add(r.score)
    assert len(scores[True]) == 1
    own = retrieval.tfidf_scores(docs.withColumnRenamed("doc_id", "query_id"), docs, F.col("text"), F.col("text"))
    assert {r.score for r in own.filter("query_id = doc_id").collect()} == {1.0}


def test_codes_tell_grams_apart():
    code = lambda t: gram_index.gram_codes(t, (3,))[0].tolist()
    assert len({*code("ab"), *code("ac"), *code("a😀"), *code("a😁")}) == 8 and gram_index.gram_codes("")[0].dtype == np.int64
    with pytest.raises(ValueError):
        gram_index._check((2, 4))


def test_empty_corpus_and_no_queries(spark):
    docs = corpus.normalised(spark.createDataFrame(rows()[:5], SHAPE))
    for d, q in ((docs.filter("false"), asked(spark)), (docs, asked(spark).filter("false"))):
        assert found(retrieval.tfidf_search(q, d, gram_index.build_index(d, X.document_text()))) == []
