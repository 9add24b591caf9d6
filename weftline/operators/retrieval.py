"""Document retrieval: character n-gram TF-IDF or dense vectors, additive boosts, candidate window and deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions import text as X
from weftline.operators.dedup import candidate_window, top_per_group
from weftline.operators.gram_index import SIZES, GramIndex, all_scores, build_index, search_scores
from weftline.sources.workspace import small, store


def char_grams(text: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Character n-grams of each word padded with a blank at either end, lower-cased. A padded word of at most n characters
    gives itself once, for the smallest such n only."""
    def cut(n: int, before: int) -> Callable[[Column], Column]:
        def of(w: Column) -> Column:
            p = F.concat(F.lit(" "), w, F.lit(" "))
            many = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(p) - (n - 1), F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))
            return many if not before else F.when(F.char_length(p) > before, many).otherwise(F.array().cast("array<string>"))

        return of

    words = F.filter(F.split(X.one_space(F.lower(text)), " "), lambda w: w != "")
    return F.concat(*[F.flatten(F.transform(words, cut(n, before))) for n, before in zip(sizes, [0, *sizes], strict=False)])


def tfidf_scores(queries: DataFrame, docs: DataFrame, query_text: Column, doc_text: Column, sizes: Sequence[int] = SIZES) -> DataFrame:
    """(query_id, doc_id, score): cosine of smoothed TF-IDF vectors, ln((1 + n) / (1 + df)) + 1, of all pairs that share a gram.

    ``queries``: column query_id; ``docs``: column doc_id. A search that needs the best pairs only takes ``tfidf_search``.
    """
    return all_scores(queries, build_index(docs, doc_text, sizes), query_text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dense_block_scores(queries: DataFrame, docs: DataFrame, window: int, vec: str = "embedding", block: int = 1024, slack: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score): of every query the pairs that can be among its best ``window`` (score, then doc_id) once up to ``slack`` is added to any score;
    vectors that are null have no score.

    Queries are taken in blocks (hash of the id, about ``block`` each) that are shipped to where the documents lie; each batch of
    documents keeps its own best ``window`` of a query, which no other batch can displace from outside. Products are summed in
    the order of the dimensions, so equal vectors have equal scores.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("_q")).filter("_q IS NOT NULL").persist()
    parts = asked.count() // block + 1
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(vec).cast("array<double>").alias("_v")).filter("_v IS NOT NULL")

    def scorer(rows: list) -> DataFrame:
        ids, vectors = np.array([r.query_id for r in rows], np.int64), np.array([r._q for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    names = batch.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(names, kind="stable")
                    names, v = names[order], np.array(batch.column(1).to_pylist(), np.float64)[order]
                    score = np.zeros((len(ids), len(names)))
                    for k in range(v.shape[1]):
                        score += vectors[:, k, None] * v[None, :, k]
                    best = np.argsort(-score, axis=1, kind="stable")[:, :window]
                    stays = np.zeros(score.shape, bool)
                    np.put_along_axis(stays, best, True, 1)
                    if slack:
                        stays |= score + slack + 1e-9 >= np.take_along_axis(score, best[:, -1:], 1)
                    asked_by, about = np.nonzero(stays)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked_by]), pa.array(names[about]), pa.array(score[asked_by, about])], names=["query_id", "doc_id", "score"])

        return slim.mapInArrow(run, "query_id long, doc_id long, score double")

    blocks = (asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).collect() for k in range(parts))
    found = [scorer(rows) for rows in blocks if rows]
    asked.unpersist()
    return reduce(DataFrame.union, found) if found else slim.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")


def embedded_scores(queries: DataFrame, docs: DataFrame, embed: Callable[[DataFrame], DataFrame], top_k: int) -> DataFrame:
    """(query_id, doc_id, score) for ``search``: products of the vectors that ``embed`` gives, (id, embedding) of (id, text), as far as boosts and matched terms can bring a
    document into the window. Ids of any kind are numbered for the product."""
    number = lambda df, c: store(df.select(c).distinct().withColumn("_n", F.monotonically_increasing_id()), "numbers")
    asked, held = number(queries, "query_id"), number(docs, "doc_id")
    q = embed(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))).join(asked, F.col("id") == F.col("query_id")).select(F.col("_n").alias("query_id"), "embedding")
    d = embed(docs.select(F.col("doc_id").alias("id"), X.document_text().alias("text"))).join(held, F.col("id") == F.col("doc_id")).select(F.col("_n").alias("doc_id"), "embedding")
    most = sum(v for k, v in rules.BOOSTS.items() if k != "term")
    scores = dense_block_scores(q, d, max(3 * top_k, 10), slack=most).withColumnsRenamed({"query_id": "_q", "doc_id": "_d"})
    named = scores.join(asked.select("query_id", F.col("_n").alias("_q")), "_q").join(held.select("doc_id", F.col("_n").alias("_d")), "_d")
    return named.select("query_id", "doc_id", "score")


def boosts(district: Column | None, tag: Column | None, unit: Column | None, types: Sequence[str]) -> Column:
    """Additive boosts of a pair whose document columns are in scope, without that of matched terms; what is not given adds none."""
    b, out = rules.BOOSTS, F.lit(0.0)

    def add(given: Column | None, test: Callable[[Column], Column], value: float) -> Column:
        return F.lit(0.0) if given is None else F.when((F.coalesce(given, F.lit("")) != "") & test(given), F.lit(value)).otherwise(F.lit(0.0))

    out = out + add(district, lambda c: F.col("district") == c, b["district"]) + add(district, lambda c: F.col("district").isin(*rules.WHOLE_CITY), b["whole_city"])
    out = out + add(tag, lambda c: F.array_contains("applicable_tags", c), b["tag"]) + add(unit, lambda c: F.col("unit") == c, b["unit"])
    return out + (F.when(F.col("doc_type").isin(*types), F.lit(b["doc_type"])).otherwise(F.lit(0.0)) if types else F.lit(0.0))


def search(queries: DataFrame, docs: DataFrame, scores: DataFrame, top_k: int = 3, types: Sequence[str] = ()) -> DataFrame:
    """(query_id, rank, doc_id, title, doc_type, district, source, score, snippet, matched_terms).

    ``queries``: query_id, query and, as far as given, query_district, query_tag, query_unit. ``docs``: corpus documents with doc_id. ``scores``: query_id, doc_id, score.
    The best max(3 k, 10) of each query are cut first, then scores of 0 or less and repeated (title, source) go, then k stay.

    Only matched terms need the text. A pair's score without them is known from slim columns, and they add at most a fixed amount: the
    best by that score are searched first, and of the others only those that can still pass them.
    """
    given = _given(queries)
    slim = docs.select("doc_id", *_FEATURES)
    base = scores.join(queries.drop("query"), "query_id").join(slim, "doc_id").select("query_id", "doc_id", (F.col("score") + boosts(given["district"], given["tag"], given["unit"], types)).alias("base"))
    return _best(queries, docs, store(base, "base"), top_k)


def tfidf_search(queries: DataFrame, docs: DataFrame, index: GramIndex, top_k: int = 3, types: Sequence[str] = (), report: list | None = None) -> DataFrame:
    """``search`` by TF-IDF through an index of ``docs`` that may have been built for earlier queries; blocks of documents that cannot reach a query's window are skipped."""
    given = _given(queries)
    boost = boosts(given["district"], given["tag"], given["unit"], types)
    base = search_scores(queries, index, F.col("query"), boost, lambda first: _leaders(queries, docs, first, top_k)[1], max(3 * top_k, 10), types, report)
    return _best(queries, docs, base.select("query_id", "doc_id", "base"), top_k)


def positive(hits: DataFrame, score: str = "score") -> DataFrame:
    """Hits with a score above 0; a score that is null or not a number is none."""
    return hits.filter((F.col(score) > 0) & ~F.isnan(F.col(score)))


_FEATURES = ("district", "unit", "doc_type", "applicable_tags")


def _given(queries: DataFrame) -> dict[str, Column | None]:
    return {n: F.col(f"query_{n}") if f"query_{n}" in queries.columns else None for n in ("district", "tag", "unit")}


def _totals(queries: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, base) with what a hit shows: matched terms are looked for in the text and added to the score."""
    asked = queries.select("query_id", X.query_terms(F.col("query"), **_given(queries)).alias("_terms"))
    whole = docs.select("doc_id", "title", "doc_type", "district", "source", X.snippet(F.col("content")).alias("snippet"), X.document_text().alias("_text"))
    found = small(pairs).join(asked, "query_id").join(whole, "doc_id").withColumn("matched_terms", X.matched_terms(F.col("_terms"), F.col("_text")))
    total = F.col("base") + F.least(F.size("matched_terms") * F.lit(rules.BOOSTS["term"]), F.lit(rules.BOOSTS["most_terms"]))
    return found.select("query_id", "doc_id", "title", "doc_type", "district", "source", total.alias("score"), "snippet", "matched_terms")


def _leaders(queries: DataFrame, docs: DataFrame, base: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(whole hits of a window's size by base, (query_id, least)): as many hits reach ``least``, so what cannot is out of the window."""
    size = max(3 * top_k, 10)
    top = store(top_per_group(base, ["query_id"], [F.desc("base"), F.col("doc_id")], size, "_r").drop("_r"), "leaders")
    totals = store(_totals(queries, docs, top), "totals")
    return totals, store(totals.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= size).select("query_id", "least"), "least")


def _best(queries: DataFrame, docs: DataFrame, base: DataFrame, top_k: int) -> DataFrame:
    totals, least = _leaders(queries, docs, base, top_k)
    near = base.join(small(least), "query_id", "left").filter(F.col("least").isNull() | (F.col("base") + (rules.BOOSTS["most_terms"] + 1e-9) >= F.col("least")))
    others = near.join(small(totals.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "base")
    kept = totals.unionByName(_totals(queries, docs, store(others, "others")))
    kept = positive(kept)
    found = candidate_window(kept, ["query_id"], [F.desc("score"), F.col("doc_id")], ["title", "source"], top_k)
    return found.select("query_id", "rank", "doc_id", "title", "doc_type", "district", "source", F.round("score", 4).alias("score"), "snippet", "matched_terms")


def describe(docs: DataFrame, backend: str, active: str, path: str) -> dict:
    return {"requested_backend": backend, "active_backend": active, "document_count": docs.count(), "corpus_path": path}
