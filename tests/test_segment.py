"""Segmentation against every way to cut a short text."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import location, segment
from weftline.sources.workspace import ship


def every_way(text, words, unknown):
    """The best of all ways by (cost, pieces), of equals that of the longest last piece, and so on leftwards."""
    ways = []
    for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        spots = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(text)]
        parts = list(itertools.pairwise(spots)) if text else []
        if all(e - s == 1 or text[s:e] in words for s, e in parts):
            cost = sum(words.get(text[s:e], unknown) for s, e in parts)
            ways.append((cost, len(parts), [s for s, _ in parts][::-1], parts))
    out = []
    for s, e in min(ways)[3]:
        known = text[s:e] in words
        if out and not known and not out[-1][1]:
            out[-1] = (out[-1][0] + text[s:e], False)
        else:
            out.append((text[s:e], known))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_best_path(seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("ab") for _ in range(draw.randrange(1, 5))): draw.choice([1, 2, 2, 3, 5]) for _ in range(draw.randrange(0, 7))}
    text = "".join(draw.choice("abc") for _ in range(draw.randrange(0, 10)))
    edges = {}
    for s in range(len(text)):
        for e in range(s + 1, len(text) + 1):
            if text[s:e] in words:
                edges.setdefault(e, []).append((s, words[text[s:e]]))
    assert [(text[s:e], k) for s, e, k in segment.best_path(len(text), edges, 6)] == every_way(text, words, 6)


@pytest.mark.parametrize("lot", [200_000, 2])
def test_segments_against_every_way(spark, monkeypatch, lot):
    ship(spark)
    monkeypatch.setattr(segment, "WORDS_AT_ONCE", lot)
    monkeypatch.setattr(segment.word_parts, "__defaults__", (lot,))
    docs = spark.createDataFrame([(1, "路灯 坏了 路灯 路灯"), (2, "坏了 路灯坏 路灯坏"), (3, "朝阳路 朝阳路 门"), (4, None)], "id long, text string")
    places = spark.createDataFrame([(3, "朝阳"), (None, "海淀")], "id long, word string")
    words = segment.lexicon(docs, F.col("text"), places)
    held = {r.word: r.cost for r in words.collect()}
    counts = {"路灯": 3, "坏了": 2, "路灯坏": 2, "朝阳路": 2, "朝阳": 1, "海淀": 1}
    total = sum(counts.values())
    assert held == {w: round((math.log(total) - math.log(n)) * segment.UNIT) for w, n in counts.items()}
    texts = [(k, t) for k, t in enumerate(["路灯坏了", "朝阳路 路灯坏 了", "门口海淀x朝阳", "", None, "q", "路灯坏路灯坏了"])]
    got = {r.id: [tuple(p) for p in r.pieces] for r in segment.segments(spark.createDataFrame(texts, "id long, text string").repartition(3), words, "id", "text").collect()}
    assert got == {k: every_way((t or "").replace(" ", ""), held, segment.unknown_cost(total)) for k, t in texts}


def test_places_on_the_path_join_the_hits(spark):
    ship(spark)
    aliases = spark.createDataFrame([("望京", "朝阳区", "dictionary", 0.84, "dictionary", 0), ("京", "东城区", "dictionary", 0.84, "dictionary", 1), ("望京", "海淀区", "dictionary", 0.84, "dictionary", 2)], "alias string, district string, category string, confidence double, source string, pos int")
    texts = spark.createDataFrame([(1, "望京 灯坏了 望京"), (2, "没有")], "id long, text string")
    words = segment.lexicon(texts, F.col("text"), aliases.select(F.lit(None).cast("long").alias("id"), F.col("alias").alias("word")))
    hits = sorted((r.id, r.pos.kind, r.district, r.matched_text, r.source, r.confidence, r.category) for r in segment.segmented_places(texts, aliases, words).collect())
    assert hits == [(1, 2, "海淀区", "望京", "segmenter", 0.80, "segmenter")] * 2
    rows = {r.id: r for r in location.resolve(texts, aliases, words=words).collect()}
    assert [p.source for p in rows[1].places] == ["dictionary"] * 3 + ["segmenter"] * 2 and rows[1].district == "海淀区" and rows[2].method == "none"


def test_no_words_and_no_texts(spark):
    ship(spark)
    none = spark.createDataFrame([], "id long, text string")
    words = segment.lexicon(none, F.col("text"))
    texts = spark.createDataFrame([(1, "ab"), (2, "")], "id long, text string")
    assert {r.id: [tuple(p) for p in r.pieces] for r in segment.segments(texts, words, "id", "text").collect()} == {1: [("ab", False)], 2: []}
    assert segment.segments(none, words, "id", "text").count() == 0
