"""Training of the linear unit classifier by distributed gradients, with or without adversarial examples."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps over all rows, the highest rate, the part of the steps in which it rises to that, and the largest norm of a gradient.
STEPS, RATE, WARM, CLIP = 30, 2.0, 0.1, 1.0
#: Length of the step that makes an example adversarial.
EPSILON = 0.1


@dataclass(frozen=True)
class Model:
    """``labels`` in order and their rows of ``weights`` (labels, dimensions + 1: the last is the bias)."""

    labels: list
    weights: np.ndarray


def usable(vec: Column, size: int) -> Column:
    """Vectors of ``size`` finite components."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == size) & ~F.coalesce(odd, F.lit(True))


def rate_at(step: int, steps: int, rate: float = RATE, warm: float = WARM) -> float:
    """The rate of a step (from 0): it rises linearly in the first part of the steps and then falls linearly to 0."""
    rising = int(steps * warm)
    return rate * (step / rising if step < rising else (steps - step) / max(1, steps - rising))


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, epsilon: float) -> tuple[np.ndarray, float]:
    """(sum of the gradients of the rows' cross entropy, sum of their losses); with ``epsilon`` the gradients at each row moved so far along its own gradient are added."""
    def at(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logits = points @ weights[:, :-1].T + weights[:, -1]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
        p[np.arange(len(y)), y] -= 1
        return p, loss

    wrong, loss = at(x)
    total = np.column_stack([wrong.T @ x, wrong.sum(0)])
    if epsilon:
        along = wrong @ weights[:, :-1]
        length = np.sqrt((along * along).sum(1, keepdims=True))
        moved = x + epsilon * np.divide(along, length, out=np.zeros_like(along), where=length > 0)
        wrong, _ = at(moved)
        total += np.column_stack([wrong.T @ moved, wrong.sum(0)])
    return total, float(loss.sum())


def update(weights: np.ndarray, total: np.ndarray, rows: int, step: int, steps: int, rate: float = RATE) -> np.ndarray:
    """The weights after a step along the mean gradient, cut to the norm ``CLIP``."""
    mean = total / max(1, rows)
    norm = float(np.sqrt((mean * mean).sum()))
    return weights - rate_at(step, steps, rate) * mean * min(1.0, CLIP / norm if norm else 1.0)


def fit(rows: DataFrame, label: str, vec: str, size: int, steps: int = STEPS, rate: float = RATE, epsilon: float = EPSILON, state: str | None = None, stop: int | None = None) -> Model:
    """The classifier of ``rows``: each step is one job in which every task adds up its own rows' gradients; a shuffle merges them by weight, so what comes to the
    driver is as large as the model. Rows whose label is null or vector is not ``usable`` are left out.

    ``state`` is a file in the folder that driver and executors share: the weights are left there after every step, and a run that finds them goes on from
    there. ``stop`` ends a run after so many of its steps (as a crash would).
    """
    spark = rows.sparkSession
    held = rows.filter(F.col(label).isNotNull() & usable(F.col(vec), size)).select(F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    labels = sorted(r.label for r in held.select("label").distinct().collect())  # the classes
    place = {v: k for k, v in enumerate(labels)}
    weights, first = np.zeros((len(labels), size + 1)), 0
    if state and (found := _load(spark, state)):
        if found["labels"] != labels or found["steps"] != steps:
            raise ValueError("the saved state is of other labels or steps")
        weights, first = np.array(found["weights"]), found["step"] + 1
    for step in range(first, steps if labels else 0):
        if stop is not None and step >= first + stop:
            break
        shared = spark.sparkContext.broadcast((place, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, w = shared.value
            total, n, loss = np.zeros_like(w), 0, 0.0
            for batch in batches:
                y = np.array([known[v] for v in batch.column(0).to_pylist()], np.int64)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                g, part = gradient(x, y, w, epsilon) if len(y) else (0.0, 0.0)
                total, n, loss = total + g, n + len(y), loss + part
            if n:
                flat = np.append(total.ravel(), [n, loss])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

        merged = {r.k: r.v for r in held.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([merged.get(k, 0.0) for k in range(weights.size + 2)])
        weights = update(weights, flat[: weights.size].reshape(weights.shape), int(flat[-2]), step, steps, rate)
        shared.unpersist()
        if state:
            _save(spark, state, {"labels": labels, "steps": steps, "step": step, "loss": flat[-1] / max(1, flat[-2]), "weights": weights.tolist()})
    return Model(labels, weights)


def predict(rows: DataFrame, model: Model, id_col: str, vec: str, label: str, k: int = 3) -> DataFrame:
    """(id, label, ranked: the ``k`` most likely labels, likeliest first, ties in label order) of rows with a usable vector."""
    size, kinds = model.weights.shape[1] - 1, dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    slim = rows.filter(usable(F.col(vec), size)).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, w = shared.value.labels, shared.value.weights
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best = np.argsort(-(x @ w[:, :-1].T + w[:, -1]), axis=1, kind="stable")[:, :k]
            ranked = pa.array([[labels[j] for j in b] for b in best.tolist()], pa.list_(batch.column(1).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ranked], names=["id", "label", "ranked"])

    return slim.mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label]}, ranked array<{kinds[label]}>")


def _file(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _save(spark, path: str, state: dict) -> None:
    """The old state stays until the new one is whole."""
    (fs, draft), (_, target) = _file(spark, f"{path}.draft"), _file(spark, path)
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def _load(spark, path: str) -> dict | None:
    """The saved state; a draft counts where the rename did not come about."""
    for name in (path, f"{path}.draft"):
        fs, p = _file(spark, name)
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return None
