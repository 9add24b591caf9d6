import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm.common import give_back_heaps, materialise
from weftline.llm.mixing import mix
from weftline.llm.packing import default_tokenizer
from weftline.llm.toxicity import score_toxicity


def near_copies(rows):
    """{id: smallest id reachable} over texts whose sets of five-word shingles have a Jaccard similarity of 0.8 and more."""
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", norm(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            common = len(sets[a] & sets[b])
            if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_stages_against_brute_force(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns == list(corpus_pipeline.COLUMNS)
    assert list(kept) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in score_toxicity(before, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - toxic

    before, after = kept["exact_dedup"]
    best = {}
    for r in before.collect():
        best[norm(r.text)] = max(best.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())

    before, after = kept["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(near_copies(rows).values()))

    before, after = kept["mixing"]
    taken = Counter({r.doc_id: r.copies if r.size else 1 for r in mix(before).collect()})
    assert Counter(r.doc_id for r in after.collect()) == +taken
    rows = {r.doc_id: hashlib.sha1(repr(r).encode()).hexdigest() for r in before.collect()}
    assert all(rows[r.doc_id] == hashlib.sha1(repr(r).encode()).hexdigest() for r in after.collect())

    before, after = kept["packing"]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in before.collect()}
    times, pieces, sequences = Counter(r.doc_id for r in before.collect()), Counter(), defaultdict(list)
    for r in after.collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter({d: len(ids[d]) * n for d, n in times.items()})
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 4096
    assert re.fullmatch(r"[a-z_]+", list(kept)[-1])


def test_stages_on_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "Same text here now", "en", "a", 4), (3, "same text here now", "en", "a", 4), (4, "x " * 30_000, None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf), name)
        docs.collect()


def test_repeated_ids_lose_no_text_and_no_column(spark, sf):
    """Rows that share an id but not a text are documents of their own in every stage, whatever other columns are called."""
    def words(k, n=60):
        return " ".join(f"w{k}x{j}" for j in range(n))

    rows = [(1, words(1)), (5, words(1) + " tail"), (5, words(2)), (5, words(3)), (1, words(4)), (None, words(5)), (None, words(5)), (7, words(6)), (7, words(6).upper())]
    odd = ["_gone", "_gone_id", "_digest", "_id", "_n", "_toxicity", "_mark", "_g1", "_COPIES", "rid", "source", "lang", "n_chars"]
    df = spark.createDataFrame([(i, t, *["z"] * len(odd)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in odd))
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == df.columns and {r[c] for r in docs.collect() for c in odd} == {"z"}
        seen[name] = Counter((r.doc_id, norm(r.text)) for r in docs.collect())
    plain = Counter((i, norm(t)) for i, t in rows)
    assert seen["toxicity"] == plain
    assert seen["exact_dedup"] == Counter({k: 1 for k in plain})
    left = Counter({k: 1 for k in plain if k != (5, norm(words(1) + " tail"))})
    assert seen["near_dedup"] == left  # the copy goes, the other texts under its id stay
    assert set(seen["mixing"]) <= set(left) and all(n <= 3 for n in seen["mixing"].values())


def test_heaps_give_back_what_was_left(spark):
    runtime, gateway = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    held = [gateway.new_array(gateway.jvm.byte, 100 << 20) for _ in range(5)]
    wide = runtime.totalMemory()
    del held
    give_back_heaps(spark)
    assert runtime.totalMemory() < wide - (200 << 20)


def test_stages_begin_on_heaps_that_gave_back(spark, sf, monkeypatch):
    """No stage does any work of its own on executors that still hold what the stage before it left."""

    class Asked(Exception):
        pass

    def asked(session):
        raise Asked

    monkeypatch.setattr(corpus_pipeline, "give_back_heaps", asked)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Asked):
            stage(spark, docs, sf)
