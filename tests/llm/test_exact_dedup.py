import hashlib
from collections import defaultdict

import pytest

from weftline.llm.exact_dedup import drop_duplicates, exact_dedup, filter_bits


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return sorted((i, max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(["", None, "É a", "é a", "ABC", "abc", "x" * 200_000, *["hot"] * 300])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = sorted(tuple(r) for r in exact_dedup(rows).collect())
    assert got == brute([tuple(r) for r in rows.collect()])


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a", "p"), (1, "A", "p"), (None, "a", "q"), (None, "b", "q"), (None, "b", "q"), (3, "c", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = exact_dedup(df).collect()
    assert sorted((r.text_sha256, r.group_size, r.kept) for r in got) == sorted((hashlib.sha256(t.encode()).hexdigest(), n, k) for t, n, k in [("a", 3, True), ("a", 3, False), ("a", 3, False), ("b", 2, True), ("b", 2, False), ("c", 1, True)])
    kept = drop_duplicates(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("1", "a"), ("3", "c"), ("None", "b")]
    assert exact_dedup(df.filter("false")).count() == 0 and drop_duplicates(df.filter("false")).count() == 0


def test_a_filter_that_is_full_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr("weftline.llm.exact_dedup.MIN_BITS", 64)
    monkeypatch.setattr("weftline.llm.exact_dedup.MAX_BITS", 64)
    rows = [(i, str(i // 2 if i < 20 else i)) for i in range(600)]
    assert sorted(tuple(r) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


@pytest.mark.parametrize(("rows", "bits"), [(0, 1 << 16), (10**6, 1 << 24), (10**12, 1 << 27)])
def test_filter_size_is_bounded(rows, bits):
    assert filter_bits(rows) == bits


def test_plan_has_no_python(spark, sf):
    plan = exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
