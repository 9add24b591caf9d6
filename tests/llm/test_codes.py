import hashlib
import math
import random
from fractions import Fraction

import pytest

from weftline.llm.codes import LONGEST, compress_vectors, decode, encode, fit_codebooks


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain integers, one vector at a time."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = []
    for i, v, g in kept:
        whole = [math.floor(4096 * Fraction(x)) for x in v] + [0] * (width * parts - len(v))
        cut.append((i, [whole[p * width : (p + 1) * width] for p in range(parts)], g))
    first = sorted(zip(kept, cut, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1]))[:entries]
    books = [[c[1][p] for _, c in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, x, _ in cut:
                held.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(t) // len(held[e]) for t in zip(*held[e], strict=True)] if e in held else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    coded = [(i, [near(x[p], books[p]) for p in range(parts)], g) for i, x, g in cut]
    errors = [min(LONGEST, sum(d for d, _ in c)) for _, c, _ in coded]
    total = {}
    for (_, _, g), e in zip(coded, errors, strict=True):
        total[g] = total.get(g, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in c), err, min(LONGEST, total[g]), sha) for (i, c, g), err in zip(coded, errors, strict=True)), key=str)


def got(df, **how):
    return sorted((tuple(r) for r in compress_vectors(df, **how).collect()), key=str)


SHAPE = "vec_id long, embedding array<double>, label int"


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_odd_rows(spark):
    draw = random.Random(3)
    rows = [(k % 37, [draw.gauss(0, 1) for _ in range(20)], draw.choice([1, 1, 1, 2, None])) for k in range(60)]
    rows += [(90, None, 1), (91, [1.0, None], 1), (92, [float("nan")] * 20, 1), (93, [float("inf")] + [0.0] * 19, 2), (94, [], 2), (95, [3.0], None), (None, [0.5] * 20, 1)]
    rows += rows[:5] + [(None, [0.5] * 20, 1)]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: df_lit(c) for c in ("id", "vector", "_label", "code", "error")})
    want = brute(rows)
    assert got(df) == want and len(want) == 69
    assert got(df.repartition(7)) == want


def df_lit(c):
    from pyspark.sql import functions as F

    return F.lit(f"another {c}")


def test_components_of_any_size_are_exact(spark):
    draw = random.Random(5)
    rows = [(k, [draw.uniform(-1, 1) * 10.0 ** draw.choice([0, 3, 6, 9, 17, 40, 300]) for _ in range(8)], k % 3) for k in range(60)]
    assert got(spark.createDataFrame(rows, SHAPE), rounds=3) == brute(rows, rounds=3)
    rows = [(k, [(1 if k % 2 else -1) * 2.0**20 + k] * 8, 0) for k in range(300)]
    assert got(spark.createDataFrame(rows, SHAPE)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [float("nan")], 1)]])
def test_nothing_usable(spark, rows):
    assert got(spark.createDataFrame(rows, SHAPE)) == []


def test_vectors_without_components(spark):
    assert got(spark.createDataFrame([(1, [], 1), (2, [], None)], SHAPE)) == brute([(1, [], 1), (2, [], None)])


def test_one_entry_that_holds_nearly_all(spark):
    rows = [(k, [0.0] * 8, None) for k in range(3000)] + [(3000 + k, [float(k)] * 8, k) for k in range(20)]
    assert got(spark.createDataFrame(rows, SHAPE).repartition(5)) == brute(rows)


def test_codes_stand_for_near_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = fit_codebooks(df, entries=64)
    for r in decode(encode(df, books), books).join(df.withColumnRenamed("vec_id", "id"), "id").collect():
        off = sum((4096 * (a - b)) ** 2 for a, b in zip(r.vector, r.embedding, strict=True))
        assert off <= (r.error**0.5 + 8) ** 2
