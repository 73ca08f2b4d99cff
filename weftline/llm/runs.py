"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from weftline.llm.common import BOX, boxed, crc_bucket, each_text, slices, small_batches, table, text_or_empty, texts, unboxed, word_values

MIN_EXPONENT, MIN_LENGTH = 4, 6


def rank_levels(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(suffix array, ranks by the first 2^k words for k = 0, 1, ..., level at which each slot parts from the one before).

    Suffixes end with their document, and documents are sorted one after the other, so no suffix of one meets another's.
    A rank is the first slot of its group. Each round sorts only the slots of groups that still have several members, by
    the rank of what follows; the last level is the inverse suffix array.
    """
    n = len(words)
    sa = np.lexsort((words, doc))
    head = np.ones(n + 1, bool)
    head[1:n] = (words[sa[1:]] != words[sa[:-1]]) | (doc[sa[1:]] != doc[sa[:-1]])
    parted = np.where(head[:n], 0, -1).astype(np.int16)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    end = np.searchsorted(doc, doc, side="right") if n else doc
    levels, step = [rank], 1
    while len(todo := np.flatnonzero(~(head[:n] & head[1:]))):
        at = sa[todo]
        follows = at + step
        second = np.where(follows < end[at], rank[np.minimum(follows, n - 1)].astype(np.int64), -1)
        key = rank[at].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sa[todo] = at[order]
        key = key[order]
        new = todo[1:][(key[1:] != key[:-1]) & ~head[todo[1:]]]
        head[new] = True
        parted[new] = len(levels)
        rank = rank.copy()
        rank[sa[todo]] = np.maximum.accumulate(np.where(head[todo], todo, 0))
        levels.append(rank)
        step *= 2
    return sa, levels, parted


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], parted: np.ndarray) -> np.ndarray:
    """Common prefix of each slot's suffix with the one before it; 0 for the first slot of a document."""
    lcp = np.zeros(len(sa), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        slot = np.flatnonzero(parted > k)
        a, b = sa[slot - 1] + lcp[slot], sa[slot] + lcp[slot]
        inside = np.maximum(a, b) < len(sa)
        equal = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        lcp[slot[equal]] += 1 << k
    return lcp


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Nearest place before with a smaller value; values[0] must be the only smallest.

    Most places find it after a few jumps over the jumps of others; the rest climb a tree of minima until a left sibling
    holds a smaller value, and go down to its last one.
    """
    at = np.arange(-1, len(values) - 1)
    at[:1] = 0
    live = np.arange(1, len(values))
    for _ in range(4):
        live = live[values[at[live]] >= values[live]]
        at[live] = at[at[live]]
    live = live[values[at[live]] >= values[live]]
    if not len(live):
        return at
    tree = [values]
    while len(tree[-1]) > 1:
        v = tree[-1]
        tree.append(np.minimum(v[0::2], np.append(v[1::2], v[-1:]) if len(v) % 2 else v[1::2]))
    node, level, want = live.copy(), np.full(len(live), -1), values[live]
    for k, minima in enumerate(tree):
        open_ = np.flatnonzero(level < 0)
        x = node[open_]
        left = (x & 1 == 1) & (minima[x - 1] < want[open_])
        level[open_[left]] = k
        node[open_] = np.where(left, x - 1, x >> 1)
    for k in range(len(tree) - 1, 0, -1):
        down = np.flatnonzero(level >= k)
        right = np.minimum(2 * node[down] + 1, len(tree[k - 1]) - 1)
        node[down] = np.where(tree[k - 1][right] < want[down], right, 2 * node[down])
    at[live] = node
    return at


def tandems(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem: two equal stretches side by side, whose next words differ.

    Each LCP interval of depth d > 0 is cut into its children. All suffixes i but those of the largest child ask the
    inverse suffix array whether i + d and i - d lie in the interval, in another child.
    """
    n = len(sa)
    ends = np.concatenate([lcp, [0]])
    ends[0] = 0
    low = smaller_before(np.concatenate([[-1], ends]))[1:] - 1
    high = n - smaller_before(np.concatenate([[-1], ends[::-1]]))[1:][::-1] + 1
    inner = np.flatnonzero(ends > 0)
    inner = inner[np.lexsort((inner, ends[inner], low[inner]))]
    if not len(inner):
        return inner, inner
    depth, left, right = ends[inner], low[inner], high[inner]
    new = np.ones(len(inner), bool)
    new[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    interval = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    # One child before each inner boundary, and one behind an interval's last.
    lo = np.concatenate([np.where(new, left, np.roll(inner, 1)), inner[np.append(heads[1:], len(inner)) - 1]])
    hi = np.concatenate([inner, right[heads]])
    of = np.concatenate([interval, np.arange(len(heads))])
    order = np.argsort(of, kind="stable")
    lo, hi, of = lo[order], hi[order], of[order]
    size = hi - lo
    starts = np.searchsorted(of, np.arange(len(heads)))
    largest = np.maximum.reduceat(size, starts)[of] == size
    place = np.where(largest, np.arange(len(of)), len(of))
    keep = np.ones(len(of), bool)
    keep[np.minimum.reduceat(place, starts)] = False
    lo, hi, of, size = lo[keep], hi[keep], of[keep], size[keep]
    child = np.repeat(np.arange(len(lo)), size)
    slot = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + lo[child]
    i, d = sa[slot], depth[heads][of[child]]
    first, last, c_lo, c_hi = left[heads][of[child]], right[heads][of[child]], lo[child], hi[child]
    found = []
    for j, start in ((i + d, i), (i - d, i - d)):
        inside = (j >= 0) & (j < n)
        t = isa[np.where(inside, j, 0)]
        hit = inside & (t >= first) & (t < last) & ~((t >= c_lo) & (t < c_hi))
        found.append((start[hit], d[hit]))
    start, period = (np.concatenate(x) for x in zip(*found))
    both = np.unique(start * (n + 1) + period)
    return both // (n + 1), both % (n + 1)


def word_runs(words: np.ndarray, doc: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and period; words and doc are numbers, doc ascending.

    A tandem is rotated to the left as long as the words agree; its run ends where the tandem does, as the next words
    differ. Tandems of one run and of multiples of its period have the same ends; the smallest period stays.
    """
    if not len(words):
        return words, words, words
    sa, levels, parted = rank_levels(words, doc)
    start, period = tandems(sa, levels[-1], common_prefixes(sa, levels, parted))
    a, b = start.copy(), start + period
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - (1 << k), b - (1 << k)
        inside = x >= 0
        equal = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)]) & (x != y)
        a[equal] -= 1 << k
        b[equal] -= 1 << k
    end = start + 2 * period
    keep = end - a >= np.maximum(min_length, min_exponent * period)
    a, end, period = a[keep], end[keep], period[keep]
    order = np.lexsort((period, end, a))
    a, end, period = a[order], end[order], period[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (end[1:] != end[:-1])
    a, end, period = a[new], end[new], period[new]
    order = np.lexsort((period, a))
    return a[order], end[order], period[order]


def collapsed(rows: list[bytes], row: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Each row's kept words, one space between two."""
    buf = np.frombuffer(b"\n".join(rows) + b" ", np.uint8)
    r, s, e = row[kept], start[kept], end[kept]
    size = e - s + 1
    last = np.cumsum(size)
    source = np.arange(int(last[-1]) if len(last) else 0) + np.repeat(s - (last - size), size)
    out = buf[source]
    out[last - 1] = 0x20
    whole = out.tobytes()
    bounds = np.concatenate([[0], last])[np.searchsorted(r, np.arange(len(rows) + 1))].tolist()
    return [whole[x : max(x, y - 1)] for x, y in zip(bounds, bounds[1:])]


_RUN = StructType([StructField(x, LongType(), False) for x in ("start", "length", "period")])


def find_runs(docs: DataFrame, text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """All columns + n_words BIGINT, runs ARRAY<STRUCT<start, length, period>>, collapsed STRING.

    A run is a stretch of consecutive words with smallest period q, of min_length words and min_exponent * q words at
    least, that no word beside it extends; runs go by start, then period, counted in words from 0. collapsed has the
    words, one space between two, without those that some run holds behind its first q words. A min_exponent below 2
    raises an error: only runs of two whole periods leave a tandem.

    A null text counts as empty: no words, no runs, an empty text. Rows are independent, so repeated rows get equal
    results. Words are compared byte by byte. A very long text is one suffix array in its own task, about 120 bytes a word,
    as a run may span all of it. Input columns named like an output are replaced, other names never clash. An empty
    table gives an empty result. No shuffle.
    """
    if min_exponent < 2:
        raise ValueError(f"min_exponent must be 2 or more: {min_exponent}")
    rows = small_batches(docs).select(boxed(docs), text_or_empty(text_col).alias("_text"))
    schema = StructType([rows.schema[BOX], StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN, False)), StructField("collapsed", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, lengths = texts(batch, "_text")
            n_words, found, out = [], [], []
            for a, b in slices(lengths):
                part = data[a:b]
                words, row, start, end = word_values(part, lower=False)
                numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                n = np.bincount(row, minlength=len(part))
                before = np.cumsum(n) - n
                first, last, period = word_runs(numbers, row, min_exponent, min_length)
                depth = np.zeros(len(row) + 1, np.int64)
                np.add.at(depth, first + period, 1)
                np.add.at(depth, last, -1)
                out += collapsed(part, row, start, end, np.cumsum(depth[:-1]) == 0)
                own = row[first] if len(first) else first
                n_words.append(n)
                found.append((own + a, first - before[own], last - first, period))
            r, s, k, q = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s, k, q)], fields=[pa.field(f.name, pa.int64(), False) for f in _RUN])
            ends = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), each, type=pa.list_(pa.field("element", each.type, False)))
            yield pa.RecordBatch.from_arrays([batch.column(BOX), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), lists, pa.array(out, pa.binary())], schema.names)

    return unboxed(rows.mapInArrow(run, schema), docs, {"n_words": F.col("n_words"), "runs": F.col("runs"), "collapsed": F.col("collapsed").cast("string")})


def planted(data: bytes, h: int) -> bytes:
    """The text of a row with hash h: in one of ten rows, words from a drawn place on repeat with a drawn period."""
    words = data.split()
    n, g = len(words), h // 10
    if h % 10 or not n:
        return data
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a])


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col, the texts rewritten by planted() with crc32 of the id as text; null texts and ids count as empty."""
    rows = small_batches(docs).select(F.col(id_col), text_or_empty(text_col).alias("_text"), crc_bucket(id_col, 1 << 32).cast("long").alias("_h"))
    schema = StructType([rows.schema[id_col], StructField("text", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [planted(data, h) for data, h in zip(each_text(batch, "_text"), batch.column("_h").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema).select(id_col, F.col("text").cast("string").alias(text_col))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_sort("runs", lambda x, y: F.coalesce(F.nullif(F.signum(y["length"] - x["length"]), F.lit(0.0)), F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"])).cast("int"))
    top = found.withColumn("best", F.get(best, F.lit(0)))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
