"""Word segmentation: the best path through the lattice of a text's words, with probabilities counted from a corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import no_space
from weftline.sources.workspace import spread, store

#: Words that one automaton holds; a longer list takes one pass over the texts for each part.
WORDS_AT_ONCE = 200_000
#: A token of the corpus is a word if it is no longer than this and occurs as often.
MOST_LETTERS, LEAST_COUNT = 16, 2
TOKEN = r"[\p{L}\p{N}]+"
#: Confidence of a place that is a word of the best path.
SEGMENTED = 0.80
#: Costs are natural logarithms times this, as integers, so that sums and ties do not depend on order.
UNIT = 1_000_000


def word_parts(words: DataFrame, at_once: int = WORDS_AT_ONCE) -> Iterator[list]:
    """Rows of ``words`` (first column: the word) in lots of about ``at_once``, one after another: what is on the driver at a time is one lot."""
    name = f"`{words.columns[0]}`"
    lots = words.count() // at_once + 1
    for k in range(lots):
        yield sorted(words.filter(F.pmod(F.xxhash64(name), F.lit(lots)) == k).collect())


def lexicon(texts: DataFrame, text: Column, places: DataFrame | None = None, least: int = LEAST_COUNT) -> DataFrame:
    """(word, cost): the corpus's tokens of at least ``least`` occurrences, and the words of ``places`` (id, word: where each occurs, one row for a text),
    with the negative logarithm of each word's share of all counts, in units. A word that is both has the larger count. Counted map-side; a word
    of ``places`` without a text is given as a row with a null id and counts once."""
    tokens = texts.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).alias("word"))
    counts = tokens.filter(F.char_length("word") <= MOST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if places is not None:
        counts = counts.unionByName(places.groupBy("word").agg(F.greatest(F.count("id"), F.lit(1)).alias("n")))
    counts = store(counts.groupBy("word").agg(F.max("n").alias("n")).filter("word <> ''"), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("word", F.round((F.log(F.lit(float(total))) - F.log(F.col("n").cast("double"))) * UNIT).cast("long").alias("cost"), F.lit(total).alias("total"))


def best_path(size: int, edges: dict[int, list[tuple[int, int]]], unknown: int) -> list[tuple[int, int, bool]]:
    """(start, end, known) of the cheapest way through positions 0 to ``size``.

    ``edges``: by end, the (start, cost) of words; any single character may be passed at the cost ``unknown``, which no word reaches. Of
    equally cheap ways the one of fewest pieces is taken, then the one whose last piece is longest, and so on leftwards.
    Unknown characters side by side are one piece.
    """
    best = [(0, 0, 0)]
    for end in range(1, size + 1):
        cost, pieces, _ = best[end - 1]
        way = (cost + unknown, pieces + 1, end - 1)
        for start, c in edges.get(end, ()):
            cost, pieces, _ = best[start]
            way = min(way, (cost + c, pieces + 1, start))
        best.append(way)
    out: list[tuple[int, int, bool]] = []
    end = size
    while end:
        start = best[end][2]
        known = any(s == start for s, _ in edges.get(end, ()))
        if out and not known and not out[-1][2]:
            out[-1] = (start, out[-1][1], False)
        else:
            out.append((start, end, known))
        end = start
    return out[::-1]


def segments(texts: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pieces array<struct<word, known>>) of every text, white space removed; a null or empty text has no pieces.

    Texts do not move: each worker finds all words of a lot by one automaton; with more than one lot the finds are put together by id and text (rows that repeat both are one).
    """
    spark, kind = texts.sparkSession, dict(texts.dtypes)[id_col]
    held = store(words, "lexicon")
    first = held.first()
    unknown = unknown_cost(first.total if first else 1)
    slim = spread(texts.select(F.col(id_col).alias("id"), no_space(F.col(text_col)).alias("text")))
    found = None
    for lot in word_parts(held.select("word", "cost")):
        shared = spark.sparkContext.broadcast([(r.word, r.cost) for r in lot])  # bounded by WORDS_AT_ONCE
        one = slim.mapInArrow(_finder(shared), f"id {kind}, text string, starts array<int>, ends array<int>, costs array<long>")
        found = one if found is None else found.unionByName(one)
    if held.count() >= WORDS_AT_ONCE:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "costs")]  # one entry for each lot
        found = found.groupBy("id", "text").agg(*lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends, costs in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                edges: dict[int, list[tuple[int, int]]] = {}
                for s, e, c in zip(starts, ends, costs, strict=True):
                    edges.setdefault(e, []).append((s, c))
                out.append([{"word": text[s:e], "known": known} for s, e, known in best_path(len(text), edges, unknown)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("known", pa.bool_())])))], names=["id", "pieces"])

    return found.mapInArrow(run, f"id {kind}, pieces array<struct<word:string,known:boolean>>")


def unknown_cost(total: int) -> int:
    """Half the probability of a word that occurs once."""
    return round((math.log(total) + math.log(2)) * UNIT)


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, cost in shared.value:
            automaton.add_word(word, (len(word), cost))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            hits = [list(automaton.iter(text)) if len(automaton) else [] for text in batch.column(1).to_pylist()]
            cut = [pa.array([[of(end, size, cost) for end, (size, cost) in h] for h in hits], pa.list_(t)) for of, t in ((lambda e, n, c: e + 1 - n, pa.int32()), (lambda e, n, c: e + 1, pa.int32()), (lambda e, n, c: c, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cut], names=["id", "text", "starts", "ends", "costs"])

    return run


def segmented_places(texts: DataFrame, aliases: DataFrame, words: DataFrame, id_col: str = "id", text_col: str = "text", stop: Sequence[str] = ()) -> DataFrame:
    """Location hits (id, pos, district, matched_text, source, confidence, category): the words of each text's best path that are aliases, each time
    they occur. An alias of several districts stands for that of its last row."""
    one = aliases.groupBy("alias").agg(F.max_by("district", "pos").alias("district")).filter((F.col("alias") != "") & ~F.col("alias").isin(*stop))
    pieces = segments(texts, words, id_col, text_col).select("id", F.posexplode("pieces").alias("at", "piece")).filter("piece.known")
    order = F.struct(F.lit(2).alias("kind"), F.lit(0).alias("shorter"), F.col("at").cast("bigint").alias("at"))
    found = pieces.select("id", "at", F.col("piece.word").alias("alias")).join(one, "alias")
    return found.select("id", order.alias("pos"), "district", F.col("alias").alias("matched_text"), F.lit("segmenter").alias("source"), F.lit(SEGMENTED).alias("confidence"), F.lit("segmenter").alias("category"))
