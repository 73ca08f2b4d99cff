"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import reliable, table

#: Queries of one block; their vectors and score bounds are all that is ever broadcast.
QUERY_BLOCK = 65_536
#: Bytes of a block's vectors, which reach the driver and are broadcast.
QUERY_BYTES = 64 << 20
#: Bins into which each round splits the range that holds a query's kth score: so many of all queries, each some.
ALL_BINS, LEAST_BINS, MOST_BINS = 4_000_000, 64, 1_024
#: Scores are 64-bit; the histograms' range ends here, and what lies beyond counts in its outermost bins.
FAR = 1 << 61
#: Scores computed at a time in a task.
CELLS = 4_000_000


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """[vec_id, q ARRAY<BIGINT>]: floor(scale * x). Rows with a null id, a null vector, or a null or non-finite component are left out."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & ~bad).select("vec_id", F.transform("_v", lambda x: F.floor(x * scale)).alias("q"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of one width; shorter rows are padded with zeros, longer ones cut to the queries' width, which adds nothing to the product."""
    flat, off = np.asarray(col.flatten()), np.asarray(col.offsets)
    off = off - off[0]
    size = np.diff(off)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, n) in enumerate(zip(off, size)):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores [candidate, query], mask of a query's own rows) in pieces of about CELLS scores."""
    most_q = int(np.abs(queries).max(initial=0))
    for batch in batches:
        vec_id, q = np.asarray(batch.column("vec_id")), _matrix(batch.column("q"), queries.shape[1])
        bound = most_q * int(np.abs(q).max(initial=0)) * max(1, queries.shape[1])  # a Python number: it can pass 64 bits
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # exact in each case
        right = queries.T.astype(kind)
        step = max(1, CELLS // max(1, len(ids)))
        for i in range(0, len(q), step):
            yield vec_id[i : i + step], (q[i : i + step].astype(kind) @ right).astype(np.int64), vec_id[i : i + step, None] == ids[None, :]


def _top_bins(low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray, bins: int, ids: np.ndarray, queries: np.ndarray):
    """A task's share of the histograms: for each query the bins from the top down to its own need-th score.

    Lower bins can't hold the global kth score, so leaving them out changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(ids), bins), np.int64)
        floor = low.copy()
        for _, s, own in _scores(batches, ids, queries):
            np.clip(s, -FAR, FAR, out=s)
            ok = (s >= floor[None, :]) & ~own
            c, j = np.nonzero(ok)
            if not len(c):
                continue
            b = (s[c, j] - low[j]) // width[j]
            inside = (b < bins) & (s[c, j] < high[j])
            np.add.at(hist, (j[inside], b[inside]), 1)
            touched = np.unique(j)
            tail = np.cumsum(hist[touched, ::-1], axis=1) >= need[touched, None]
            kth = np.where(tail.any(axis=1), bins - 1 - tail.argmax(axis=1), 0)
            floor[touched] = np.maximum(floor[touched], low[touched] + kth * width[touched])
        keep = hist * (low[:, None] + np.arange(bins) * width[:, None] >= floor[:, None])
        j, b = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(keep[j, b])], ["j", "bin", "n"])

    return run


def _block(cands: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, span: tuple[int, int]) -> DataFrame:
    n = len(ids)
    bins = min(MOST_BINS, max(LEAST_BINS, ALL_BINS // n))
    low, need = np.full(n, span[0], np.int64), np.full(n, k, np.int64)
    width = np.full(n, max(1, -(-(span[1] - span[0] + 1) // bins)), np.int64)
    high = low + width * bins
    while True:
        part = cands.mapInArrow(_top_bins(low, high, width, need, bins, ids, queries), "j int, bin int, n long")
        w = Window.partitionBy("j").orderBy(F.desc("bin"))
        bounds = F.broadcast(cands.sparkSession.createDataFrame([(int(j), int(x)) for j, x in enumerate(need)], "j int, need long"))  # QUERY_BLOCK rows
        totals = part.groupBy("j", "bin").agg(F.sum("n").alias("n")).withColumn("above", F.sum("n").over(w) - F.col("n")).join(bounds, "j")
        found = totals.filter("above < need").groupBy("j").agg(F.max_by(F.struct("bin", "above"), "above").alias("x")).select("j", "x.*").collect()
        for r in found:
            low[r["j"]] += r["bin"] * width[r["j"]]
            need[r["j"]] -= r["above"]
        high = low + width
        if (width == 1).all():
            break
        width = np.maximum(1, -(-width // bins))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All scores above the kth; of those equal to it the k smallest ids of this task, which hold the global ones."""
        for vec_id, s, own in _scores(batches, ids, queries):
            c, j = np.nonzero((s >= low[None, :]) & ~own)
            v, got = vec_id[c], s[c, j]
            order = np.lexsort((v, got != low[j], j))
            tie = got[order] == low[j[order]]
            first = np.searchsorted(j[order], j[order])
            order = order[~tie | (np.arange(len(order)) - first < k)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[j[order]]), pa.array(v[order]), pa.array(got[order])], ["query_id", "vec_id", "score"])

    return cands.mapInArrow(keep, "query_id long, vec_id long, score long")


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """[query_id, rank, vec_id, score]: each query's k highest integer inner products, ties to the smaller vec_id.

    Both frames hold vec_id BIGINT and q ARRAY<BIGINT> (see quantised). A candidate with the query's id is left out.
    Queries go in blocks of QUERY_BLOCK rows and QUERY_BYTES at most; each block is broadcast, scores all candidates once a round, and narrows the
    range of every query's kth score many-fold from global histograms until it is one integer. Only rows at or above it
    leave the tasks. Scores must fit 64 bits. Equal query ids count once (the smallest vector). Empty inputs give an empty result.
    """
    spark = candidates.sparkSession
    top = candidates.select(F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))), F.max(F.size("q"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if top[0] is None:
        return spark.createDataFrame([], schema)
    one = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    n = one.count()
    longest = one.agg(F.max(F.size("q"))).first()[0] or 1
    limit = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, longest))))
    n_blocks = -(-n * 5 // (4 * limit)) if n > limit else min(n, 1)  # hashed, so filled to four fifths
    parts = []
    if n_blocks:
        blocks = reliable(one.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))))
        for b in range(n_blocks):
            rows = blocks.filter(F.col("_block") == b).select("vec_id", "q").toArrow().combine_chunks().sort_by("vec_id")
            if not rows.num_rows:
                continue
            ids, lists = rows.column("vec_id").to_numpy(), rows.column("q").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            width = int(size.max())
            q = np.zeros((len(ids), width), np.int64)
            q[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy()
            most = int(top[0]) * int(np.abs(q).max(initial=0)) * width
            part = _block(candidates, ids, q, k, (-min(most, FAR), min(most, FAR)))
            parts.append(reliable(part) if n_blocks > 1 else part)
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    cands = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_top_k(cands, cands.filter("vec_id % 50 = 0"), 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
