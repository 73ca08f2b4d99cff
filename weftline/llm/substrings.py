"""Exact substring dedup: removes every byte under a fixed-length string that also starts earlier.

Winnowing picks, in each string of the length sought, the GRAM-byte gram of least hash; the string belongs to that
anchor. Equal strings have equal anchors, so strings with the same anchor hash form a shard's material and no pair is ever
sought across shards. A fixed-size sieve of anchor hashes, made in a first pass, says which anchors occur more than once,
which have different surroundings, and which are hot. Where all surroundings agree, their hash and the anchor's, 128 bits
together, stand for all strings of the anchor. Where they differ the surrounding bytes go to the anchor's shard, whose
suffixes are ranked by Larsson-Sadakane refinement in numpy; a hot anchor's strings go to shards of their own hash
instead. The first start of each class stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegralType, LongType, StructField, StructType

from weftline.functions.lineage import ordered_index
from weftline.llm import common
from weftline.llm.common import BOX, ROWS_AT_ONCE, boxed, mix, slices, small_batches, table, text_or_empty, texts, unboxed, whole_groups

#: Longer grams repeat by chance less often, at the cost of more anchors; half the length at most.
GRAM = 32
#: Slots of the sieve, two bits each: a size that doesn't grow with the corpus. A collision only sends more to the shards.
SIEVE_BITS = 27
BUCKET_BITS = 12
#: Different surroundings in one anchor from which its strings are dealt out singly; below it they fit in one task easily.
HOT = 16_384
#: Rows of shards that are ranked at once.
SHARD_ROWS = 20_000
SHIP_BYTES = 4 << 20
_POS = np.uint64((1 << 30) - 1)
_LAST = np.iinfo(np.int64).max


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: running minima of blocks of w, from the left and from the right."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Anchors:
    """The anchors of a run of documents: per anchor its hash, its first string's start, its number of strings, its surroundings' hash."""

    def __init__(self, rows: list[bytes], length: int) -> None:
        self.data = b"".join(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ends = np.cumsum(sizes)
        n, none = len(self.data), np.empty(0, np.int64)
        self.hash = self.around = np.empty(0, np.uint64)
        self.first = self.count = none
        if n < length:
            return
        power, inverse = common._power_table(n + 1)
        self.prefix = np.empty(n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum((np.frombuffer(self.data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])
        self.inverse = inverse
        gram = min(GRAM, (length + 1) // 2)
        grams = mix((self.prefix[gram:] - self.prefix[:-gram]) * inverse[: n - gram + 1])
        least = _sliding_min(grams & ~_POS | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        ok = np.ones(len(least) + 1, bool)
        for end, size in zip(self.ends.tolist(), sizes.tolist()):
            ok[max(end - min(size, length - 1), 0) : end] = False  # strings never cross documents
        ok = ok[: len(least)]
        new = np.append(True, least[1:] != least[:-1])
        start = ok & (new | np.append(True, ~ok[:-1]))
        stop = ok & (np.append(new[1:], True) | np.append(~ok[1:], True))
        self.first = np.flatnonzero(start)
        self.count = np.flatnonzero(stop) - self.first + 1
        self.hash = grams[(least[self.first] & _POS).astype(np.int64)]
        self.around = self.digest(self.first, self.first + self.count - 1 + length)

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def _chunks(batch: pa.RecordBatch, col: str, length: int) -> Iterator[tuple[int, int, Anchors]]:
    rows, sizes = texts(batch, col)
    for a, b in slices(sizes, SHIP_BYTES):
        yield a, b, Anchors(rows[a:b], length)


def _sieve(docs: DataFrame, length: int) -> np.ndarray:
    """Two bits a slot: 0 single, 1 repeated with equal surroundings, 2 with different ones, 3 hot."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in _chunks(batch, "_text", length):
                if not len(x.hash):
                    continue
                got = np.stack([x.hash, x.around], axis=1)
                got = got[np.lexsort((got[:, 1], got[:, 0]))]
                same = np.append(False, (got[1:] == got[:-1]).all(axis=1))
                got = got[~(same & np.append([False, False], same[1:-1] if len(same) > 1 else [])[: len(same)])]  # two of a kind say as much as more
                bucket = (got[:, 0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([got[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())], ["bucket", "pairs"])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket", 1):
            of = np.asarray(group.column("bucket"))
            packed = group.column("pairs").to_pylist()
            for bucket in np.unique(of):
                got = np.frombuffer(b"".join(packed[i] for i in np.flatnonzero(of == bucket)), np.uint64).reshape(-1, 2)
                got = got[np.lexsort((got[:, 1], got[:, 0]))]
                lead = np.flatnonzero(np.append(True, got[1:, 0] != got[:-1, 0]))
                n = np.diff(np.append(lead, len(got)))
                fresh = np.append(True, (got[1:] != got[:-1]).any(axis=1))
                kinds = np.add.reduceat(fresh.astype(np.int64), lead)
                level = np.where(n < 2, 0, np.where(kinds < 2, 1, np.where(kinds < HOT, 2, 3))).astype(np.uint8)
                slots = np.zeros(1 << (SIEVE_BITS - BUCKET_BITS), np.uint8)
                at = ((got[lead, 0] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - SIEVE_BITS + BUCKET_BITS)).astype(np.int64)
                np.maximum.at(slots, at, level)
                four = slots.reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), pa.array([(four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()], pa.binary())], ["bucket", "slots"])

    rows = docs.mapInArrow(pairs, "bucket int, pairs binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(levels, "bucket int, slots binary").collect()
    out = np.zeros((1 << BUCKET_BITS, 1 << (SIEVE_BITS - BUCKET_BITS - 2)), np.uint8)  # 2 ** BUCKET_BITS rows of a fixed size
    for r in rows:
        out[r["bucket"]] = np.frombuffer(r["slots"], np.uint8)
    return out.ravel()


def refine(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A rank of text[p : p + length] for each start p; equal exactly where those bytes are equal.

    Suffixes are ranked by their first eight bytes, then by doubling: only groups of more than one are refined, by the
    rank of what follows, and a group's first place stays its rank (Larsson and Sadakane).
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + length, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | padded[j : j + n + length]
    order = np.argsort(word)
    change = np.append(True, word[order[1:]] != word[order[:-1]])
    place = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = place
    active = order[~(change & np.append(change[1:], True))]
    depth = 8
    while depth < length and len(active):
        step = min(depth, length - depth)
        active = active[active + step < len(rank)]
        own, then = rank[active], rank[active + step]
        by = np.argsort(own << 32 | then)  # ranks stay far below 2 ** 31
        active, own, then = active[by], own[by], then[by]
        old = np.append(True, own[1:] != own[:-1])
        new = old | np.append(True, then[1:] != then[:-1])
        i = np.arange(len(active))
        rank[active] = own + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(old, i, 0))
        active = active[~(new & np.append(new[1:], True))]
        depth += step
    return rank[starts]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.append(0, cut + 1)], x[np.append(cut, len(x) - 1)]


def _ship(sieve, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for the shards. Of strings alike in one run of documents only the first goes; the others are settled here."""
    names = ["shard", "anchor", "doc_id", "key", "start", "n", "around"]
    slots = sieve.value
    for batch in batches:
        keys, ids = np.asarray(batch.column("_key")), np.asarray(batch.column("_id"))
        for a, b, x in _chunks(batch, "_text", length):
            slot = (x.hash >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
            level = slots[slot >> 2] >> ((slot & 3) * 2).astype(np.uint8) & 3
            keep = level > 0
            first, count, anchor, around, level = (v[keep] for v in (x.first, x.count, x.hash, x.around, level))
            hot = level == 3
            each = np.where(hot, count, 1)
            at = np.repeat(np.arange(len(first)), each)
            within = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            first = first[at] + np.where(hot[at], within, 0)
            count = np.where(hot[at], 1, count[at])
            level, anchor = level[at], anchor[at]
            around = np.where(hot[at], x.digest(first, first + length), around[at]) if len(at) else around[at]
            row = np.searchsorted(x.ends, first, side="right")
            offset = np.append(0, x.ends)[row]
            shard = np.where(level == 2, anchor, around).view(np.int64)
            order = np.lexsort((first, keys[a + row], ids[a + row], anchor, around))
            fresh = np.append(True, (around[order][1:] != around[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
            lead = np.sort(order[fresh]) if len(order) else order
            rest = np.sort(order[~fresh]) if len(order) else order
            if len(lead):
                bytes_ = [x.data[s : s + n - 1 + length] if lv == 2 else None for s, n, lv in zip(first[lead].tolist(), count[lead].tolist(), level[lead].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard[lead]), pa.array(anchor[lead].view(np.int64)), pa.array(ids[a + row[lead]]), pa.array(keys[a + row[lead]]), pa.array(first[lead] - offset[lead]), pa.array(count[lead]), pa.array(bytes_, pa.binary())], names)
            if len(rest):  # settled: n is negative and the shard says nothing
                each = count[rest]
                starts = np.unique(np.repeat(first[rest] - (np.cumsum(each) - each), each) + np.arange(each.sum()))
                s, e = _runs(starts)
                r = np.searchsorted(x.ends, s, side="right")
                off = np.append(0, x.ends)[r]
                yield pa.RecordBatch.from_arrays([pa.array(mix(keys[a + r].view(np.uint64) + s.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(len(s), np.int64)), pa.array(ids[a + r]), pa.array(keys[a + r]), pa.array(s - off), pa.array(s - e - 1), pa.nulls(len(s), pa.binary())], names)


def _settle(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, first, last): runs of starts whose string also starts earlier."""
    for group in whole_groups(batches, "shard", SHARD_ROWS):
        shard, anchor, ids, keys, start, n = (np.asarray(group.column(c)) for c in ("shard", "anchor", "doc_id", "key", "start", "n"))
        done = n < 0
        out = [(ids[done], keys[done], start[done], start[done] - n[done] - 1)]
        spelt = np.asarray(group.column("around").is_valid())
        plain = np.flatnonzero(~done & ~spelt)
        plain = plain[np.lexsort((start[plain], keys[plain], ids[plain], anchor[plain], shard[plain]))]
        later = plain[np.append(False, (shard[plain][1:] == shard[plain][:-1]) & (anchor[plain][1:] == anchor[plain][:-1]))] if len(plain) else plain
        out.append((ids[later], keys[later], start[later], start[later] + n[later] - 1))
        rows = np.flatnonzero(spelt & ~done)
        if len(rows):
            rows = rows[np.lexsort((start[rows], keys[rows], ids[rows]))]
            same = group.column("around").take(pa.array(rows)).combine_chunks().dictionary_encode().indices
            lead = np.zeros(len(rows), bool)
            lead[np.unique(np.asarray(same), return_index=True)[1]] = True  # of equal surroundings only the earliest is ranked
            later = rows[~lead]
            out.append((ids[later], keys[later], start[later], start[later] + n[later] - 1))
            rows = rows[lead]
            _, back, many = np.unique(shard[rows], return_inverse=True, return_counts=True)
            rows = rows[many[back] > 1]
        if len(rows):
            data = group.column("around").take(pa.array(rows)).to_pylist()
            text = np.frombuffer(b"".join(data), np.uint8)
            size = n[rows] + length - 1
            base = np.cumsum(size) - size
            of = np.repeat(np.arange(len(rows)), n[rows])
            within = np.arange(len(of)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            rank = refine(text, base[of] + within, length)
            order = np.argsort(rank, kind="stable")  # rows are in document order, so each class's first is its earliest
            again = np.sort(order[np.append(False, rank[order][1:] == rank[order][:-1])])
            if len(again):
                flat = again + of[again]  # a gap between rows, so that runs don't cross them
                s, e = _runs(flat)
                i = of[again[np.searchsorted(flat, s)]]
                j = again[np.searchsorted(flat, s)]
                out.append((ids[rows[i]], keys[rows[i]], start[rows[i]] + within[j], start[rows[i]] + within[j] + e - s))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], ["doc_id", "key", "first", "last"])


def _cut(length: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at_row in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at_row, ROWS_AT_ONCE)
            kept, spans = [], []
            for text, runs in zip(batch.column("_bytes").to_pylist(), batch.column("_runs").to_pylist()):
                merged: list[list[int]] = []
                for r in sorted((r["first"], r["last"] + length) for r in runs or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                at, parts = 0, []
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept.append(b"".join(parts))
                spans.append([{"first": a, "last": b} for a, b in merged])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.binary()), pa.array(spans, kind)], [*names, "kept", "removed"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """All columns but text_col + n_bytes BIGINT, kept BINARY, removed ARRAY<STRUCT<first, last>>: each text without the
    removed byte spans [first, last).

    A byte goes if a string of length bytes over it also starts earlier: in a document of smaller id, or earlier in its
    own. Ids can be of any type that has an order. Null ids come last; among texts with one id a content hash decides, and
    rows equal in id and text count as one document, so each gets the same result. Null and short texts keep all; very
    long ones are read whole. Input columns named like an output are replaced, other names never clash. An empty table
    gives an empty result. Anchors that occur once are never shuffled; of equal surroundings one goes out of each run of
    documents; texts are shuffled once, to meet their spans.
    """
    box = docs.select(boxed(docs, text_col), F.col(id_col).alias("_own"), text_or_empty(text_col).alias("_text"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        rows = box.withColumn("_id", F.coalesce(F.col("_own").cast("long"), F.lit(_LAST)))
    else:  # their rank stands for them
        ranks = ordered_index(docs.select(F.col(id_col).alias("_own")).filter("_own IS NOT NULL").distinct(), F.col("_own"), name="_id")
        rows = box.join(ranks, "_own", "left").withColumn("_id", F.coalesce("_id", F.lit(_LAST)))
    rows = small_batches(rows).withColumn("_key", F.xxhash64("_own", F.lit("/"), "_text"))
    read = rows.select("_id", "_key", "_text")
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(read.select("_text"), length))  # 2 ** SIEVE_BITS / 4 bytes
    shipped = read.mapInArrow(partial(_ship, sieve, length), "shard long, anchor long, doc_id long, key long, start long, n long, around binary")
    later = shipped.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(_settle, length), "doc_id long, key long, first long, last long")
    runs = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("_runs")).withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    joined = rows.join(runs, ["_id", "_key"], "left").select(BOX, F.octet_length("_text").cast("long").alias("n_bytes"), F.col("_text").cast("binary").alias("_bytes"), "_runs")
    span = ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType())]))
    schema = StructType([*joined.schema.fields[:2], StructField("kept", BinaryType()), StructField("removed", span)])
    out = joined.mapInArrow(partial(_cut, length, [BOX, "n_bytes"]), schema)
    return unboxed(out, docs, {c: F.col(c) for c in ("n_bytes", "kept", "removed")}, text_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
