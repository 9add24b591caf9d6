"""Distributed training against plain numpy on all rows at once, and a run that is broken off and goes on."""

import numpy as np
import pytest

from weftline.operators import adversarial as A
from weftline.sources.workspace import ship


def plain(x, y, classes, steps, epsilon):
    w = np.zeros((classes, x.shape[1] + 1))
    for step in range(steps):
        total = np.zeros_like(w)
        for xi, yi in zip(x, y, strict=True):
            def off(point):
                z = w[:, :-1] @ point + w[:, -1]
                p = np.exp(z - z.max())
                p /= p.sum()
                p[yi] -= 1
                return p

            e = off(xi)
            total += np.outer(e, np.append(xi, 1))
            g = w[:, :-1].T @ e
            if epsilon:
                moved = xi + epsilon * g / np.linalg.norm(g) if np.linalg.norm(g) else xi
                total += np.outer(off(moved), np.append(moved, 1))
        mean = total / len(x)
        rising = int(steps * 0.1)
        rate = 2.0 * (step / rising if step < rising else (steps - step) / (steps - rising))
        w = w - rate * mean * min(1, 1 / np.linalg.norm(mean))
    return w


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 90)
    x = np.round(rng.normal(size=(90, 4)) + 2 * np.eye(4)[y], 3)
    odd = [(900, None, [0.0] * 4), (901, "b", None), (902, "b", [1.0]), (903, "a", [float("nan")] * 4), (904, "a", [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame([(k, "abc"[c], v.tolist()) for k, (c, v) in enumerate(zip(y, x, strict=True))] + odd, "id long, label string, vec array<double>")
    return df.repartition(4), x, y


@pytest.mark.parametrize("epsilon", [0.0, 0.3])
def test_equal_to_plain_numpy(table, epsilon):
    df, x, y = table
    model = A.fit(df, "label", "vec", 4, steps=12, epsilon=epsilon)
    want = plain(x, y, 3, 12, epsilon)
    assert model.labels == ["a", "b", "c"] and np.allclose(model.weights, want, atol=1e-9)
    ranked = {r.id: r.ranked for r in A.predict(df, model, "id", "vec", "label", 2).collect()}
    logits = x @ want[:, :-1].T + want[:, -1]
    assert {k: ranked[k] for k in range(90)} == {k: ["abc"[j] for j in np.argsort(-z, kind="stable")[:2]] for k, z in enumerate(logits)} and set(ranked) == {*range(90), 900}
    assert np.mean([ranked[k][0] == "abc"[c] for k, c in enumerate(y)]) > 0.8


def test_a_broken_run_goes_on(table, tmp_path):
    df, x, y = table
    path = str(tmp_path / "state.json")
    A.fit(df, "label", "vec", 4, steps=8, state=path, stop=3)
    done = A.fit(df, "label", "vec", 4, steps=8, state=path)
    assert np.allclose(done.weights, plain(x, y, 3, 8, A.EPSILON), atol=1e-9)
    with pytest.raises(ValueError):
        A.fit(df, "label", "vec", 4, steps=9, state=path)


def test_nothing_to_learn_from(spark, table):
    assert A.fit(table[0].filter("label IS NULL"), "label", "vec", 4).labels == []
