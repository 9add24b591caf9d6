"""Evaluation of predictions, and the scorers that make them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def top_units(logits: Column, names: Column, k: int = 3) -> Column:
    """The ``k`` most likely units as array<struct(unit, confidence)>, confidence in percent to one decimal; ties keep list order."""
    p = softmax(logits)
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(F.get(names, r["i"]).alias("unit"), F.round(-r["p"] * 100, 1).alias("confidence")))


def centroids(rows: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """(label, centroid): the mean vector of each class, by one aggregate per component (combined map-side)."""
    sums = rows.groupBy(label).agg(*[F.avg(F.col(vec)[k].cast("double")).alias(f"c{k}") for k in range(dim)])
    return sums.select(label, F.array(*[F.col(f"c{k}") for k in range(dim)]).alias("centroid"))


def centroid_scores(rows: DataFrame, means: DataFrame, id_col: str, label: str, vec: str) -> DataFrame:
    """(id, scored: array<struct(score, label)>): dot products with all centroids, largest first, ties to the smaller label.
    The centroids are one row per class and travel as one array."""
    table = means.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("_means"))
    from weftline.operators.retrieval import dot

    scored = F.transform("_means", lambda m: F.struct((-dot(F.col(vec), m["centroid"])).alias("neg"), m["label"].alias("label")))
    ranked = F.transform(F.array_sort(scored), lambda s: F.struct((-s["neg"]).alias("score"), s["label"].alias("label")))
    return rows.join(F.broadcast(table), F.lit(True), "inner").select(id_col, label, ranked.alias("scored"))


def top_k_accuracy(rows: DataFrame, label: Column, predicted: Column, k: int) -> DataFrame:
    """Part of rows whose label is among the first ``k`` predictions; 0 of no rows."""
    hit = F.array_contains(F.slice(predicted, 1, k), label).cast("double")
    return rows.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count("*").alias("rows"))


def class_report(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) of every label seen in either column; 0 where a ratio has no denominator."""
    pairs = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    right = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    both = pairs.select(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guesses"), right.alias("right"))
    both = both.unionByName(pairs.select(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guesses"), F.lit(0).cast("long").alias("right")))
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guesses", "right")])
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = sums.select("label", part(F.col("right"), F.col("guesses")).alias("precision"), part(F.col("right"), F.col("support")).alias("recall"), "support")
    f1 = part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def frequent_errors(rows: DataFrame, top: int = 15, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    wrong = rows.filter(F.col(truth) != F.col(predicted))
    return wrong.groupBy(truth, predicted).agg(F.count("*").alias("count")).orderBy(F.desc("count"), truth, predicted).limit(top)


def scorer(score: Callable[[list[str]], np.ndarray], load: Callable[[], object] | None = None):
    """A pandas UDF (text -> array<double>) around any model: ``load`` runs once per worker, ``score`` per batch of texts."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if load is not None:
            load()
        for texts in batches:
            yield pd.Series(list(np.asarray(score(texts.fillna("").tolist()), dtype=float)))

    return run
