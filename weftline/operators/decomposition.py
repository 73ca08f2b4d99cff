"""Singular values and axes of distributed tables: each task multiplies its rows in numpy, partial products are added up by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import written

#: Columns up to which the whole Gram matrix is made in one pass; more columns of the range than asked for; rounds; residual.
WHOLE, OVERSAMPLE, ROUNDS, RESIDUAL = 1_024, 10, 60, 1e-9
#: Blocks of the range that the driver holds, and their products: columns of the table by BLOCKS (k + OVERSAMPLE) each.
BLOCKS = 4
#: Products of a batch that are held at once.
AT_ONCE = 4_000_000


def _dense(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)


def gram_times(rows: DataFrame, q: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """A'A q for the table A of rows [x] (dense, less mean) or [i ARRAY<INT>, w ARRAY<DOUBLE>] (sparse).

    A task hands on one row a column of A that it has met; these are added up by column, and the sum, of the shape of q,
    reaches the driver: columns by a few hundred.
    """
    n, l = q.shape
    shared = rows.sparkSession.sparkContext.broadcast((q, mean))
    dense = "x" in rows.columns

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, mean = shared.value
        out, seen = np.zeros((n, l)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            if dense:
                a = _dense(batch, n) if mean is None else _dense(batch, n) - mean
                out += a.T @ (a @ q)
                continue
            sizes = np.diff(batch.column("i").offsets.to_numpy())
            at, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "w"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for first in range(0, len(sizes), step := max(1, AT_ONCE // max(1, l * int(sizes.max(initial=1))))):
                a, b = ends[first], ends[min(first + step, len(sizes))]
                row = np.repeat(np.arange(len(sizes[first : first + step])), sizes[first : first + step])
                y = np.zeros((len(sizes[first : first + step]), l))
                np.add.at(y, row, w[a:b, None] * q[at[a:b]])
                np.add.at(out, at[a:b], w[a:b, None] * y[row])
        if seen:
            met = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([out[i].tobytes() for i in met], pa.binary())], ["c", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column("c").to_pylist(), batch.column("v").to_pylist()):
                held[c] = held[c] + np.frombuffer(v) if c in held else np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["c", "v"])

    out = np.zeros((n, l))
    for r in rows.mapInArrow(multiply, "c long, v binary").repartition("c").mapInArrow(add, "c long, v binary").collect():
        out[r["c"]] = np.frombuffer(r["v"])
    shared.unpersist()
    return out


def axes(rows: DataFrame, n: int, k: int, seed: int = 0, mean: np.ndarray | None = None, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, n by k right singular vectors) of the k largest; each vector's largest element is positive.

    Up to `whole` columns one pass gives the Gram matrix. Beyond, a range finder: a random block of k + OVERSAMPLE columns is
    multiplied by A'A, and each round adds what the best vectors' images have outside the range so far (a pass over A),
    until their residuals are small; after BLOCKS blocks it starts anew from the best vectors.
    """
    l = n if n <= whole else min(n, k + OVERSAMPLE)
    basis = np.eye(n) if l == n else np.linalg.qr(np.random.default_rng(seed).standard_normal((n, l)))[0]
    products = gram_times(rows, basis, mean)
    for _ in range(ROUNDS):
        t = basis.T @ products
        values, turn = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-values)[:l]
        values, vectors, images = values[order], basis @ turn[:, order], products @ turn[:, order]
        rest = images - vectors * values
        if l == n or np.linalg.norm(rest[:, :k], axis=0).max() <= RESIDUAL * max(values[k - 1], 1e-12 * values[0]):
            break
        if basis.shape[1] + l > min(n, BLOCKS * l):
            basis, products = vectors, images
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        new, size = np.linalg.qr(rest)
        new = new[:, np.abs(np.diag(size)) > 1e-13 * max(values[0], 1e-300)]
        if not new.shape[1]:
            break
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        basis, products = np.hstack([basis, new]), np.hstack([products, gram_times(rows, new, mean)])
    values, vectors = np.maximum(values[:k], 0), vectors[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.sqrt(values), vectors * np.where(sign == 0, 1, sign)


def column_means(rows: DataFrame) -> np.ndarray:
    return np.array([r["m"] for r in rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()])  # a row a column


def singular_spectrum(rows: DataFrame, centred: bool = True) -> DataFrame:
    """[i, sigma]: singular values above 1e-9 of the largest of the (centred) table of x, largest first; the table stays distributed."""
    x = written(rows.select("x"))
    n = x.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    sigma = axes(x, n, n, mean=column_means(x) if centred else None, whole=n)[0] if n else []
    return rows.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(sigma) if v > 1e-9 * sigma[0]], "i int, sigma double")


def truncated_svd(train: DataFrame, rows: DataFrame, key: str, k: int = 256, seed: int = 0) -> DataFrame:
    """[key, x]: sparse rows [key, term, weight] on the first min(k, terms - 1) right singular vectors of train, uncentred.

    With under two of them rows stay as they are, in the order of their terms; terms that train doesn't have count nothing.
    The vectors, terms by k, are broadcast.
    """
    terms = [r["term"] for r in train.select("term").distinct().orderBy("term").collect()]  # a vocabulary of max_features
    spark, n = rows.sparkSession, len(terms)
    at = F.broadcast(spark.createDataFrame(list(zip(terms, range(n))), "term string, i int"))
    packed = lambda df: df.join(at, "term", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "weight")))).alias("p")).select(key, F.transform("p", lambda p: p["i"]).alias("i"), F.transform("p", lambda p: p["weight"]).alias("w"))
    dim = min(k, n - 1)
    v = axes(written(packed(train).select("i", "w")), n, dim, seed)[1] if dim >= 2 else np.eye(max(n, 1))
    shared = spark.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            out = [v[i].T @ np.array(w) if i else np.zeros(v.shape[1]) for i, w in zip(batch.column("i").to_pylist(), batch.column("w").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], [key, "x"])

    return packed(rows).mapInArrow(project, f"`{key}` {rows.schema[key].dataType.simpleString()}, x array<double>")
