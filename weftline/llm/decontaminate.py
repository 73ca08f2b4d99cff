"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from weftline.llm.common import BOX, ROWS_AT_ONCE, boxed, shingles, slices, small_batches, stored, table, text_or_empty, unboxed, words_of

MIN_MATCH, MIN_COVERAGE = 5, 0.8
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20
#: Seed pairs that are held at one time.
PAIRS = 2_000_000
#: 1 where a byte belongs to a token: ASCII letters and digits and all of non-ASCII.
_ALNUM = np.array([1 if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)


class Benchmark:
    """Token hashes of a block of items, with postings of their running hashes of min_match tokens.

    An item of fewer tokens is posted by its whole length; one without tokens never matches.
    """

    def __init__(self, texts: list[str], min_match: int) -> None:
        self.flat, row, _, _ = words_of([t.lower().encode() for t in texts], False, _ALNUM)
        self.start = np.searchsorted(row, np.arange(len(texts) + 1))
        self.size = np.diff(self.start)
        need = np.minimum(self.size, min_match)
        self.postings: dict[int, tuple[np.ndarray, ...]] = {}
        for k in np.unique(need[need > 0]).tolist():
            s, at = shingles(self.flat, row, k)
            mine = need[row[at]] == k
            s, at = s[mine], at[mine]
            order = np.argsort(s, kind="stable")
            s, at = s[order], at[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sieve = np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=1 << 20).astype(bool)
            self.postings[k] = s[first], first, np.diff(np.append(first, len(s))), row[at], at, sieve

    def runs(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, item, k, [(diagonal, item position, length in seeds)]) of all stretches where tokens agree, k at least.

        Seed pairs are found a bounded number at a time and kept as runs on their diagonal, so a text that repeats one word
        without end gives runs, not pairs.
        """
        for k, (seeds, first, times, item_of, at_of, sieve) in self.postings.items():
            s, at = shingles(h, row, k)
            likely = sieve[(s >> np.uint64(44)).astype(np.int64)]
            s, at = s[likely], at[likely]
            seed = np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)
            same = seeds[seed] == s
            seed, at = seed[same], at[same]
            n, found = times[seed], []
            ends = np.cumsum(n)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + PAIRS, side="right")))
                each = n[i:j]
                post = np.repeat(first[seed[i:j]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                here, there = np.repeat(at[i:j], each), at_of[post]
                agree = np.ones(len(here), bool)
                for x in range(k):  # seeds only propose; the tokens themselves are compared
                    agree &= h[here + x] == self.flat[there + x]
                here, there, item = here[agree], there[agree], item_of[post[agree]]
                found.append(_as_runs(row[here], item, here - there, there - self.start[item], np.ones(len(here), np.int64)))
                i = j
            if not found:
                continue
            r, item, d, i, n = _as_runs(*(np.concatenate(c) for c in zip(*found)))
            cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(item) != 0)) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(r)).tolist()):
                if b > a:
                    yield int(r[a]), int(item[a]), k, np.stack([d[a:b], i[a:b], n[a:b]], axis=1)


def _as_runs(row: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches (row, item, diagonal, first item position, length), sorted, with those that adjoin joined."""
    order = np.lexsort((i, d, item, row))
    row, item, d, i, n = row[order], item[order], d[order], i[order], n[order]
    if not len(row):
        return row, item, d, i, n
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (d[1:] != d[:-1]) | (i[1:] != i[:-1] + n[:-1]))
    first = np.flatnonzero(new)
    return row[first], item[first], d[first], i[first], np.add.reduceat(n, first)


def tile(runs: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item of that many tokens from runs (diagonal, item position i, seeds): [(length, i, j)].

    The longest match whose tokens are all free is marked first (ties: the earliest in the text, then in the item); a
    match that is partly taken goes back with its longest free parts of k tokens or more. It ends when all of the item
    is marked. Text positions j count from any origin that the runs share.
    """
    heap = [(-(n + k - 1), i + d, i) for d, i, n in runs.tolist()]
    heapq.heapify(heap)
    used_i, used_j = bytearray(size), set()
    left = size
    tiles = []
    while heap and left >= k:
        n, j, i = heapq.heappop(heap)
        free = [x for x in range(-n) if not used_i[i + x] and j + x not in used_j]
        if len(free) == -n:
            tiles.append((-n, i, j))
            used_i[i : i - n] = b"\1" * -n
            used_j.update(range(j, j - n))
            left += n
            continue
        first = 0
        for x in range(1, len(free) + 1):
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - first >= k:
                    heapq.heappush(heap, (-(x - first), j + free[first], i + free[first]))
                first = x
    return tiles


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[tuple], bool]]:
    """([(item, text)], whether it is the last block) of blocks of about BLOCK_BYTES."""
    rows = benchmark.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        got = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        if got:
            yield sorted(((r["item"], r["text"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1])), b == n - 1


def _coverages(col: pa.Array, bench: Benchmark) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, tiles, tiled tokens, coverage) of every pair that shares a seed."""
    for at in range(0, len(col), ROWS_AT_ONCE):
        got = pc.utf8_lower(col.slice(at, ROWS_AT_ONCE)).cast(pa.binary()).to_pylist()
        for a, b in slices(np.fromiter(map(len, got), np.int64, len(got))):
            h, row, _, _ = words_of(got[a:b], False, _ALNUM)
            for r, item, k, runs in bench.runs(h, row):
                tiles = tile(runs, k, int(bench.size[item]))
                n = sum(t[0] for t in tiles)
                yield at + a + r, item, len(tiles), n, n / int(bench.size[item])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """[id_col, item_col, n_tiles INT, n_tokens INT, coverage DOUBLE]: the documents that hold min_coverage of an item.

    Tokens are lower-cased runs of letters and digits. Coverage is the share of the item's tokens under tiles, so a
    passage whose parts stand in another order is caught. Null texts are empty and match nothing; repeated rows each give
    their pairs; very long texts are read whole; other columns are left out; an empty side gives an empty result. Whole
    texts are read where they lie: nothing is shuffled. The benchmark is broadcast in blocks of BLOCK_BYTES, one at a time:
    with several blocks each one's pairs are written before the next block goes out.
    """
    spark = small_batches(docs).sparkSession
    item_type = benchmark.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = StructType([StructField("_id", docs.schema[id_col].dataType), StructField("_item", item_type), StructField("n_tiles", IntegerType()), StructField("n_tokens", IntegerType()), StructField("coverage", DoubleType())])
    out = spark.createDataFrame([], schema)
    for block, last in _blocks(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast((Benchmark([t for _, t in block], min_match), [i for i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench, ids = shared.value
            for batch in batches:
                kept = [x for x in _coverages(batch.column(1), bench) if x[4] >= min_coverage]
                cols = list(zip(*kept)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([ids[i] for i in cols[1]], to_arrow_type(item_type)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], schema.names)

        part = rows.mapInArrow(run, schema)
        if not last:
            part = stored(part)
            shared.unpersist()
        out = out.unionAll(part)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_tiles", "n_tokens", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, item_col: str = "item_id") -> DataFrame:
    """docs without the rows that hold min_coverage of an item; all columns as they are. See matches."""
    spark = small_batches(docs).sparkSession
    out = docs
    for block, last in _blocks(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(Benchmark([t for _, t in block], min_match))
        held = out.select(boxed(docs), text_or_empty(text_col).alias("_text"))
        schema = StructType([held.schema[BOX], StructField("_hit", BooleanType())])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                hit[[x[0] for x in _coverages(batch.column(1), shared.value) if x[4] >= min_coverage]] = True
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit)], schema.names)

        out = unboxed(held.mapInArrow(run, schema).filter("NOT _hit"), docs, {})
        if not last:
            out = stored(out)
            shared.unpersist()
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
