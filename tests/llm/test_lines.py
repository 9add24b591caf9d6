import hashlib
import random
from collections import defaultdict

import pytest

from weftline.llm import lines as L
from weftline.llm.lines import dedup_lines, keep_bitmaps, line_dedup_digests


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    """(doc, text) to (doc, lines, dropped, kept text)."""
    place = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(place(d))
    out = []
    for d, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if len(key(x)) < 10 or min(holders[key(x)]) == place(d)]
        out.append((d, len(whole), len(whole) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df).collect()), key=str)


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want and sum(w[2] for w in want) > 100
    digests = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup_digests(df).collect()), key=str)
    assert digests == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want), key=str)


def odd_rows():
    draw = random.Random(7)
    pool = [f"a line of the pool, number {k}" for k in range(60)] + ["short", "", "   ", "ÄÖÜ ÄÖÜ ÄÖÜ", "äöü äöü äöü", "A LINE OF THE POOL, NUMBER 3", "\t a line of the pool, number 3\r", "\xa0a line of the pool, number 3", "tenletters", "ninechars"]
    rows = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 12)))) for k in range(200)]
    rows += [(None, pool[0] + "\nonly under no id"), (None, "only under no id\n" + pool[1]), (900, None), (901, ""), (902, "\n"), (903, "\n\n" + pool[2] + "\n")]
    rows += [(904, "twice in one text\ntwice in one text"), (905, "under one id twice, again"), (905, "under one id twice, again\nand more of it"), (1, "another text under an id that is there\n" + pool[4])]
    return rows + rows[:9] + [(1000 + k, "the hot line is here\nand its own: %d" % k) for k in range(400)]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert got(df.repartition(7)) == brute(rows)


def test_bitmaps_that_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    rows = odd_rows()
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_frequent_keys_change_nothing(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L, "SAMPLED", 1)
    for share in (1e-6, 0.25, 1e6):
        monkeypatch.setattr(L, "SHARE", share)
        assert got(df) == brute(rows)


def test_very_long_texts(spark):
    rows = [(k, "\n".join(f"line number {n % 70_000} of a long text" for n in range(k * 30_000, k * 30_000 + 150_000))) for k in (0, 1, 2)] + [(9, "x" * 3_000_000)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([(1, "one line of text", "a", 5, 1.0), (2, "one line of text\nb", None, 6, 2.0), (2, "one line of text\nb", None, 6, 2.0)], "doc_id long, text string, `_words` string, n_dropped int, `key.pos` double")
    out = dedup_lines(df)
    assert sorted(out.columns) == sorted(["doc_id", "_words", "key.pos", "text", "n_lines", "n_dropped"])
    assert sorted((r.doc_id, r.text, r._words or "", r["key.pos"], r.n_dropped) for r in out.collect()) == [(1, "one line of text", "a", 1.0, 0), (2, "b", "", 2.0, 1), (2, "b", "", 2.0, 1)]


def test_bitmaps_hold_dropped_lines_only(spark):
    text = "\n".join(f"a line of its own, {k}" for k in range(200))
    df = spark.createDataFrame([(1, "the same line twice"), (2, text + "\nthe same line twice"), (3, text.replace("own", "new"))], "doc_id long, text string")
    (row,) = keep_bitmaps(df).collect()
    assert row.doc == 2 and [(w.word, w.mask) for w in row.keep] == [(3, ~(1 << 8))]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None)] * 3])
def test_nothing_to_drop(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_plan(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    inner = L.dropped_lines
    monkeypatch.setattr(L, "dropped_lines", lambda lines: seen.append(inner(lines)) or seen[-1])
    plans = [line_dedup_digests(docs), *seen]
    assert seen
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    ordered = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert ordered.count("rangepartitioning") == 1 and "hashpartitioning" not in ordered
