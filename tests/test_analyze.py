"""The analysis: which backend retrieves, what the generator is asked, and what is used of its answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import rules
from weftline.operators import corpus, retrieval
from weftline.plans.analyze import Config, active_backend, analyze
from weftline.sources.workspace import ship

DOCS = "doc_id long, title string, content string, district string, source string"
LETTERS = "abcdefgh"


def embed(rows):
    """A text's letters as a unit vector."""
    counts = F.array(*[(F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(1e-9), lambda a, x: a + x * x))
    return rows.withColumn("v", counts).select("id", F.transform("v", lambda x: x / length(F.col("v"))).alias("embedding"))


@pytest.fixture(scope="module")
def tables(spark):
    ship(spark)
    docs = corpus.normalised(spark.createDataFrame([(k, f"t{k}", LETTERS[k % 8] * (k % 5 + 1) + LETTERS[k % 3], ["朝阳区", "海淀区", None][k % 3], "s") for k in range(60)], DOCS))
    asked = spark.createDataFrame([("r1", "环境", "aab", "朝阳区 abba"), ("r2", "环境", "cc", "gg hh"), ("r3", "环境", "", "x"), ("r4", "环境", "路灯", "坏了")], "request_id string, tag string, title string, body string")
    aliases = spark.createDataFrame([], "alias string, district string, category string, confidence double, source string, pos int")
    return docs, asked, aliases


def test_backend_needs_embeddings():
    assert active_backend(Config(backend="bge"), embed) == "bge" and active_backend(Config(backend="bge"), None) == active_backend(Config(backend="x"), embed) == "tfidf"
    assert Config.from_environment({"RAG_BACKEND": "BGE", "TOP_K": "5"}) == Config(5, False, "bge")


def test_bge_scores_every_document(spark, tables):
    docs, asked, aliases = tables
    got = {r.request_id: [(h.doc_id, h.score) for h in r.retrieval or []] for r in analyze(asked, aliases, docs, embed=embed, config=Config(backend="bge")).collect()}
    vec = lambda t: np.array([t.count(c) for c in LETTERS], float)
    unit = lambda v: v / np.sqrt(1e-9 + (v * v).sum())
    rows = docs.orderBy("doc_id").collect()
    for who, text, district, terms in (("r1", "aab 朝阳区 abba", "朝阳区", ["朝阳区", "aab", "abba"]), ("r2", "cc gg hh", None, ["cc", "gg", "hh"])):
        want = []
        for r in rows:
            whole = f"{r.title}\n{r.content}\n{r.district}\n{r.doc_type}"
            score = unit(vec(text)) @ unit(vec(whole)) + (0.15 * (r.district == district) + 0.05 * (r.district in rules.WHOLE_CITY) if district else 0) + min(0.12, 0.02 * sum(t in whole for t in terms))
            want.append((round(-score, 9), r.doc_id))
        assert [i for i, _ in got[who]] == [i for _, i in sorted(want)[:3]] and all(abs(a + b) < 1e-3 for (_, a), (b, _) in zip(got[who], sorted(want)[:3], strict=True))
    assert got["r3"] == []


def test_slack_keeps_what_can_still_pass(spark):
    vectors = [(k, [float(k % 10) / 10]) for k in range(50)]
    docs = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert retrieval.dense_block_scores(asked, docs, 5).count() == 5 and retrieval.dense_block_scores(asked, docs, 5, slack=0.2).count() == 15


def test_generator_is_asked_and_tidied(spark, tables):
    docs, asked, aliases = tables
    seen = {r.request_id: r.reply for r in analyze(asked, aliases, docs, generate=lambda p: F.concat(F.lit("您好，"), p)).collect()}
    assert seen["r1"].startswith("<|im_start|>system\n" + rules.SYSTEM_WITH_CONTEXT[:10]) and "[1] " in seen["r1"] and "行政区: 朝阳区" in seen["r1"] and seen["r3"] is None
    assert rules.SYSTEM_SIMPLE[:10] in seen["r4"] and "标题: 路灯" in seen["r4"] and "检索到" not in seen["r4"]
    blank = {r.request_id: r.reply for r in analyze(asked, aliases, docs, generate=lambda p: F.lit("您好，")).collect()}
    assert blank == {r.request_id: r.reply for r in analyze(asked, aliases, docs).collect()} and blank["r4"].startswith("经核实")


def test_classifier_decides_unless_forced(spark, tables):
    docs, asked, aliases = tables
    classify = lambda tag, title, body: F.array(F.struct(F.concat(F.lit("U"), F.char_length(body)).alias("unit"), F.lit(99.0).alias("confidence")))
    forced = asked.withColumn("forced_unit", F.when(F.col("request_id") == "r2", F.lit("市政")))
    got = {r.request_id: r.primary_unit for r in analyze(forced, aliases, docs, classify=classify).collect()}
    assert got == {"r1": "U8", "r2": "市政", "r3": None, "r4": "U2"}


def test_requests_that_come_too_soon_are_refused(spark, tables):
    docs, asked, aliases = tables
    at = {"r1": ("ip", 0.0), "r2": ("ip", 2.9), "r3": ("ip", 3.0), "r4": ("other", 1.0)}
    times = spark.createDataFrame([(k, c, float(t)) for k, (c, t) in at.items()], "request_id string, ip string, t double").withColumn("t", F.timestamp_seconds("t"))
    got = {r.request_id: r for r in analyze(asked.join(times, "request_id"), aliases, docs, limit_by=("ip", "t")).collect()}
    assert {k: (r.is_valid, r.reply is not None) for k, r in got.items()} == {"r1": (True, True), "r2": (False, False), "r3": (False, False), "r4": (True, True)}
    assert got["r2"].errors == [rules.RATE_LIMIT_ERROR] and got["r3"].errors == ["标题不能为空"]
