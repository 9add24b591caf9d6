"""Vector code compression: product quantisation in exact integers, codebooks refined over all vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, materialise, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A sum leaves its task in limbs of so many bits, which Spark adds up as longs; the limbs of 2**39 tasks still fit.
LIMB = 24
LONGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """A vector that is not null and holds no null, NaN or infinite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: int64 where all results are below 2**62, Python integers else."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < (1 << 62) / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [n * scale // d for n, d in (float(v).as_integer_ratio() for v in x.ravel())]
    return np.array([*exact, None], object)[:-1].reshape(x.shape)


def integer_parts(vectors: pa.Array, width: int, parts: int, scale: int = SCALE) -> np.ndarray:
    """(rows, parts, width) integers of a list array; what a vector lacks at its end is 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = _floors(vectors.flatten().to_numpy(zero_copy_only=False), scale)
    if len(sizes) and (sizes == parts * width).all():
        return flat.reshape(len(sizes), parts, width)
    out = np.zeros((len(sizes), parts * width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(sizes), parts, width)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance), each (rows, parts), of integer vectors (rows, parts, width) and codebooks (parts, entries, width).

    |x - c|^2 = |x|^2 - 2xc + |c|^2: all distances of a part are one integer matrix product. They are int64 where none of its
    terms can overflow, Python integers else; argmin takes the first of equals.
    """
    fits = 4 * max(1, x.shape[2]) * max(_largest(x), _largest(books)) ** 2 < 1 << 63
    kind = np.int64 if fits else object
    x, books = x.astype(kind).transpose(1, 0, 2), books.astype(kind)
    far = (x * x).sum(2)[:, :, None] - 2 * np.matmul(x, books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    entry = far.argmin(2)
    return entry.T, np.take_along_axis(far, entry[:, :, None], 2)[:, :, 0].T


def _limbs(slot: int, place: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """``total`` in limbs, lowest first; the highest has the sign."""
    for limb in range(total.bit_length() // LIMB + 1):
        last = limb == total.bit_length() // LIMB
        yield slot, place, limb, total >> limb * LIMB if last else (total >> limb * LIMB) & ((1 << LIMB) - 1)


def _sums(shared, parts: int, width: int, entries: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's sums and counts by entry: one row for each limb of a component; the count is at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = integer_parts(batch.column(0), width, parts, scale)
            slots = (nearest(x, shared.value)[0] + np.arange(parts) * entries).ravel()
            (used, at), flat = np.unique(slots, return_inverse=True), x.reshape(-1, width)
            if x.dtype == object or _largest(x) * len(flat) >= 1 << 62:
                flat = flat.astype(object)
            part = np.zeros((len(used), width), flat.dtype)
            np.add.at(part, at, flat)
            sums[used] += part
            counts += np.bincount(slots, minlength=len(counts))
        rows = [r for s in np.flatnonzero(counts).tolist() for k, v in [(-1, int(counts[s])), *enumerate(map(int, sums[s]))] for r in _limbs(s, k, v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["slot", "place", "limb", "total"])

    return run


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """(parts, entries, width) of the ``entries`` smallest ids' vectors; fewer if there are fewer. ``kept``: id, vector."""
    length = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-length // parts)
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()  # at most ``entries``
    x = integer_parts(pa.array([r.vector for r in rows], pa.list_(pa.float64())), width, parts, scale)
    return x.transpose(1, 0, 2)


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width) integers after ``rounds`` rounds over all usable vectors.

    Each round broadcasts the codebooks (parts x entries x width numbers), assigns every part of every vector to its nearest
    entry (a tie to the lower one) and replaces each used entry by the componentwise floor of sum / count. A task gives
    one sum for each entry and place, whatever its rows, so an entry that holds most vectors is no hot key; the sums are merged by
    a shuffle and are exact at any size (limbs). A round is one job over the table; what a lost executor held is computed again.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    books = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        shared = spark.sparkContext.broadcast(books)
        part = in_batches(kept.select("vector"), _sums(shared, parts, books.shape[2], books.shape[1], scale), "slot int, place int, limb int, total long")
        merged = part.groupBy("slot", "place", "limb").agg(F.sum("total").alias("total")).collect()  # a few numbers for each component of the codebooks
        total: dict[tuple[int, int], int] = {}
        for r in merged:
            total[r.slot, r.place] = total.get((r.slot, r.place), 0) + (r.total << r.limb * LIMB)
        new = books.astype(object)
        for (slot, place), v in total.items():
            if place >= 0:
                new[slot // books.shape[1], slot % books.shape[1], place] = v // total[slot, -1]
        books = new if _largest(new) >= 1 << 62 else new.astype(np.int64)
        shared.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, code array<int>, error): the nearest entry of each part and the squared distances summed over parts, of all usable
    vectors. An error above the longest long is given as that."""
    kept = vectors.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    kinds, parts, width = dict(kept.dtypes), books.shape[0], books.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = nearest(integer_parts(batch.column(2), width, parts, scale), shared.value)
            error = pa.array([min(LONGEST, sum(map(int, f))) for f in far.tolist()], pa.int64())
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(entry) + 1, dtype=np.int32) * parts), pa.array(entry.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, error], names=["id", "label", "code", "error"])

    empty = books.size == 0 and books.shape[1] == 0
    schema = f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long"
    return vectors.sparkSession.createDataFrame([], schema) if empty else in_batches(kept, run, schema)


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vector``: what the codes stand for, each component at the middle of its unit."""
    spot = F.lit([[[(int(v) + 0.5) / scale for v in entry] for entry in part] for part in books.tolist()])
    return coded.withColumn("vector", F.flatten(F.transform("code", lambda c, k: F.element_at(F.element_at(spot, k + 1), c + 1))))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are dropped. The others are as long as the longest of them, rounded up to a multiple of
    ``parts``: what a vector lacks at its end counts as 0. Rows that repeat an id, or a whole row, each count; where an id names several
    of the first codebooks' rows, the smaller vector comes first, and null ids come last. Rows with equal labels (null labels
    together) have the same label_error. Components of any finite size are exact; an error or label_error above the longest long
    is given as that. An empty table, or one without a usable vector, gives no rows. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256, two hex digits")
    books = fit_codebooks(vectors, id_col, vec_col, parts, entries, rounds)
    coded = materialise(encode(vectors, books, id_col, vec_col, label_col), "codes")
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    per_label = materialise(coded.groupBy(F.col("label").alias("_label")).agg(exact.alias("label_error")), "label_errors")
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = coded.join(small(per_label), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """SQL of ``compress_vectors`` for vectors of equal length, a multiple of ``parts``: the rounds written out one after another."""
    out = [f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        piece AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS r(p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM piece
          WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    near = "SELECT vec_id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM piece JOIN b{k} USING (p)) GROUP BY vec_id, p, x"
    for k in range(rounds):
        out.append(f"""
        a{k} AS MATERIALIZED ({near.format(k=k)}),
        s{k} AS (SELECT p, e, i, CAST((sum(x[i + 1]) - ((sum(x[i + 1]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM a{k}, range((SELECT max(len(x)) FROM piece)) AS r(i) GROUP BY p, e, i),
        l{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM s{k} GROUP BY p, e),
        b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM b{k} b LEFT JOIN l{k} l ON l.p = b.p AND l.e = b.e)""")
    out.append(f"""
        z AS MATERIALIZED ({near.format(k=rounds)}),
        w AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM w JOIN kept USING (vec_id), h""")
    return ",".join(out)
