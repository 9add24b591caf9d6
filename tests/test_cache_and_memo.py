"""The expiring cache against a plain one, in batch and as a stream; results that are kept and when they are computed again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import cache, memo
from weftline.sources.workspace import ship
from weftline.streaming import caching, flows

START = datetime(2024, 1, 1)


def log(n=600, seed=4):
    draw = random.Random(seed)
    at, rows = START, []
    for k in range(n):
        at += timedelta(seconds=draw.choice([0, 1, 60, 600, 4000, 40_000]))
        rows.append((k, at, draw.choice([1, 1, 1, 2, 3]), draw.choice(["a", "b", "c", "d", "e", None])))
    return rows


def plain(rows, size, ttl):
    """What a dictionary with times does, access by access."""
    held, out = {}, []
    for i, at, who, item in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        mine, item = held.setdefault(who, {}), item or ""
        if item in mine and (at - mine[item]).total_seconds() <= ttl:
            mine[item] = at
            out.append((who, i, "hit", None, len(mine)))
            continue
        for old in [k for k, t in mine.items() if (at - t).total_seconds() > ttl]:
            del mine[old]
        gone = min(mine, key=lambda k: mine[k]) if len(mine) >= size else None
        if gone is not None:
            del mine[gone]
        mine[item] = at
        out.append((who, i, "miss", gone, len(mine)))
    return sorted(out, key=str)


SHAPE = "event_id long, ts timestamp, user_id long, event_type string"


def found(df):
    return sorted(((r.user_id, r.event_id, r.outcome, r.evicted, r.held) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "ttl"), [(1, 50), (3, 1000), (3, 100_000), (9, 5000)])
def test_replay(spark, size, ttl):
    ship(spark)
    want = plain(log(), size, ttl)
    assert found(cache.replay(spark.createDataFrame(log(), SHAPE).repartition(5), size, ttl)) == want
    assert {w[2] for w in want} == {"hit", "miss"}


def test_stream_over_several_batches(spark, tmp_path):
    ship(spark)
    rows = log(240)
    for k in range(4):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with caching.keyed_state(spark):
        source = flows.read_files(spark, f"{tmp_path}/in", SHAPE, files_per_batch=1)
        flows.append_to(caching.cached(source, 2, 3000), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert found(spark.read.parquet(f"{tmp_path}/out")) == plain(rows, 2, 3000)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != caching._ROCKS


def test_no_accesses(spark):
    assert cache.replay(spark.createDataFrame([], SHAPE), 3, 10).count() == 0


REQUESTS = "id long, q string, place string"


def asked(spark, ids):
    return spark.createDataFrame([(i, None if i % 7 == 0 else f"q{i % 5}", "p" if i % 2 else None) for i in ids], REQUESTS)


def lengths(seen):
    def compute(unseen):
        seen.append(sorted(((r.q, r.place) for r in unseen.collect()), key=str))
        many = F.when(F.col("q") == "q3", F.lit(0)).otherwise(F.lit(2))
        rows = unseen.select("query_id", F.explode(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))).alias("rank"), "q")
        return rows.select("query_id", "rank", F.concat_ws("-", "q", "rank").alias("hit"))

    return compute


def test_only_unseen_requests_are_computed(spark, tmp_path):
    kept, seen = memo.Memo(spark, f"{tmp_path}/memo"), []
    first = kept.answers(asked(spark, range(10)), ["q", "place"], "v1", lengths(seen)).collect()
    again = kept.answers(asked(spark, range(40)), ["q", "place"], "v1", lengths(seen)).collect()
    third = kept.answers(asked(spark, range(40)), ["q", "place"], "v1", lengths(seen)).collect()
    whole = memo.Memo(spark, f"{tmp_path}/other").answers(asked(spark, range(40)), ["q", "place"], "v1", lengths([])).collect()
    plain_rows = lambda rows: sorted((r.id, str(r.q), str(r.place), [tuple(x) for x in r.results]) for r in rows)
    assert plain_rows(again) == plain_rows(third) == plain_rows(whole) and len(first) == 10
    assert not set(seen[0]) & set(seen[1]) and seen[2] == [] and len(seen[0]) == len(set(seen[0]))
    assert {(r.q, r.place) for r in again if r.fresh} == set(seen[1]) and not any(r.fresh for r in third)
    assert all(r.results == [] for r in again if r.q == "q3") and all(len(r.results) == 2 for r in again if r.q not in ("q3",))
    kept.compact("v1")
    assert len(kept.parts("v1")) == 1 and plain_rows(kept.answers(asked(spark, range(40)), ["q", "place"], "v1", lengths(seen)).collect()) == plain_rows(whole)


def test_another_version_is_computed_again_and_invalidated(spark, tmp_path):
    kept, seen = memo.Memo(spark, f"{tmp_path}/memo"), []
    for version in ("v1", "v2", "v2"):
        kept.answers(asked(spark, range(5)), ["q", "place"], version, lengths(seen)).collect()
    assert len(seen[0]) == len(seen[1]) > 0 and seen[2] == []
    assert kept.invalidate("v2") == ["v1"] and kept.versions() == ["v2"] and kept.stored("v1") is None


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    kept = memo.Memo(spark, f"{tmp_path}/memo")

    def broken(unseen):
        return unseen.select("query_id", F.raise_error(F.lit("no")).cast("int").alias("x"))

    with pytest.raises(Exception, match="no"):
        kept.answers(asked(spark, range(5)), ["q"], "v1", broken)
    assert kept.stored("v1") is None
    assert kept.answers(asked(spark, range(5)), ["q", "place"], "v1", lengths([])).filter("fresh").count() == 5


def test_two_runs_that_computed_the_same(spark, tmp_path):
    kept = memo.Memo(spark, f"{tmp_path}/memo")
    kept.answers(asked(spark, range(6)), ["q", "place"], "v1", lengths([]))
    (part,) = kept.parts("v1")
    spark.read.parquet(part).write.parquet(f"{tmp_path}/memo/version=v1/part=other")
    out = kept.answers(asked(spark, range(6)), ["q", "place"], "v1", lengths([]))
    assert out.count() == 6 and not out.filter("fresh").count()


def test_versions_of_a_corpus(spark):
    docs = spark.createDataFrame([(1, "a", None, ["x"]), (2, None, "b", [])], "id long, t string, u string, tags array<string>")
    name = memo.corpus_version(docs)
    assert name == memo.corpus_version(docs.repartition(3)) and len(name) == 32
    others = [docs.filter("id = 1"), docs.union(docs), docs.select("id", F.col("u").alias("t"), F.col("t").alias("u"), "tags"), docs.withColumn("tags", F.array(F.lit("x")))]
    assert len({name, memo.corpus_version(docs, "top 5"), *map(memo.corpus_version, others)}) == 6
