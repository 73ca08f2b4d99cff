"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import boxed, reliable, table, text_or_empty, unboxed, whole_groups

#: Items that the driver packs at most, whatever the table's size; groups that one task packs, and the bins it packs them into.
DRIVER_ITEMS, RANGE_ITEMS, RANGE_BINS = 16_384, 4_096, 256
#: Sub-buckets of each shard in which slots are counted, so that no task numbers a whole shard.
SLOT_BUCKETS = 512
#: Groups that one task packs into shards of a fixed capacity, and rows into which a group is multiplied for the join.
RANGE_GROUPS, SALT = 100_000, 16


@dataclass(frozen=True)
class Packing:
    bin_of: dict
    loads: list[int]


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.left, self.right, self.height = key, None, None, 1


class RemainingTree:
    """Bins by (remaining capacity, bin) in a height-balanced search tree: every step takes the logarithm of their number."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def tightest(self, size: int) -> int | None:
        """The bin with the least remaining capacity that holds the size; of equal ones the smallest bin."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                node, best = node.left, node.key
            else:
                node = node.right
        return best[1] if best else None

    def emptiest(self) -> int:
        """The bin with the most remaining capacity; of equal ones the smallest bin."""
        node = self.root
        while node.right:
            node = node.right
        return self.tightest(node.key[0])

    def move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            self.root = self._without(self.root, (old, b))
        self.root = self._with(self.root, (new, b))

    @staticmethod
    def _height(node: _Node | None) -> int:
        return node.height if node else 0

    def _turned(self, node: _Node, left: bool) -> _Node:
        up = node.right if left else node.left
        if left:
            node.right, up.left = up.left, node
        else:
            node.left, up.right = up.right, node
        for x in (node, up):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return up

    def _balanced(self, node: _Node) -> _Node:
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._turned(node.left, True)
            return self._turned(node, False)
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._turned(node.right, False)
            return self._turned(node, True)
        return node

    def _with(self, node: _Node | None, key: tuple[int, int]) -> _Node:
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._with(node.left, key)
        else:
            node.right = self._with(node.right, key)
        return self._balanced(node)

    def _without(self, node: _Node, key: tuple[int, int]) -> _Node | None:
        if key < node.key:
            node.left = self._without(node.left, key)
        elif key > node.key:
            node.right = self._without(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key = least.key
            node.right = self._without(node.right, least.key)
        return self._balanced(node)


def best_fit_decreasing(items: list[tuple[object, int]], capacity: int, n_bins: int | None = None) -> Packing:
    """Packs (key, size) items, the largest first, each into the bin whose remaining capacity is the least that holds it.

    Without n_bins a new bin opens when none holds the item (so few fixed-capacity bins are used; an item above the
    capacity gets a bin of its own). With n_bins the number is fixed and an item that fits nowhere goes to the emptiest
    bin. Ties: larger size, then smaller key; then smaller bin.
    """
    tree, loads, bin_of = RemainingTree(), [0] * (n_bins or 0), {}
    for b in range(n_bins or 0):
        tree.move(b, None, capacity)
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        b = tree.tightest(size)
        if b is None and n_bins is None:
            b = len(loads)
            loads.append(0)
            tree.move(b, None, capacity - size)
        else:
            b = tree.emptiest() if b is None else b
            tree.move(b, capacity - loads[b], capacity - loads[b] - size)
        loads[b] += size
        bin_of[key] = b
    return Packing(bin_of, loads)


def _packed_within(capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_group, range, bin): best-fit decreasing of the groups of each range; a range is about RANGE_GROUPS groups."""
    for held in whole_groups(batches, "_range", 1):
        ranges, keys, sizes = np.asarray(held.column("_range")), held.column("_group").to_pylist(), held.column("bytes").to_pylist()
        for r in np.unique(ranges):
            at = np.flatnonzero(ranges == r).tolist()
            bins = best_fit_decreasing([(keys[i], sizes[i]) for i in at], capacity).bin_of
            yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.string()), pa.array([int(r)] * len(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], ["_group", "_range", "_bin"])


def _fixed_capacity(groups: DataFrame, capacity: int) -> DataFrame:
    """[_group, shard]: every real group in a shard of the capacity; a larger one has a shard of its own.

    Groups are dealt by hash over ranges, and each range is packed in one task. Only a range's last shards can be badly
    filled, so the number of shards is above that of one packing by a small share.
    """
    n = groups.count()
    ranges = max(1, n // RANGE_GROUPS)
    dealt = groups.withColumn("_range", F.pmod(F.xxhash64("_group"), F.lit(ranges))).select("_range", "_group", "bytes")
    packed = reliable(dealt.repartition("_range").sortWithinPartitions("_range").mapInArrow(partial(_packed_within, capacity), "_group string, _range long, _bin long"))
    used = packed.groupBy("_range").agg((F.max("_bin") + 1).alias("n")).orderBy("_range").collect()  # one row a range
    first, at = [], 0
    for r in used:
        first.append((r["_range"], at))
        at += r["n"]
    starts = groups.sparkSession.createDataFrame(first, "_range long, _first long")
    return packed.join(F.broadcast(starts), "_range").select("_group", (F.col("_first") + F.col("_bin")).cast("int").alias("shard"))  # a row for RANGE_GROUPS groups


def _packed_evenly(bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_group, _bin, bytes): best-fit decreasing of each range's groups into so many bins of about equal bytes."""
    for held in whole_groups(batches, "_range", 1):
        ranges, keys, sizes = np.asarray(held.column("_range")), held.column("_group").to_pylist(), held.column("bytes").to_pylist()
        for r in np.unique(ranges):
            at = np.flatnonzero(ranges == r).tolist()
            capacity = -(-sum(sizes[i] for i in at) // bins)
            bin_of = best_fit_decreasing([(keys[i], sizes[i]) for i in at], capacity, bins).bin_of
            size = {keys[i]: sizes[i] for i in at}
            yield pa.RecordBatch.from_arrays([pa.array(list(bin_of), pa.string()), pa.array([f"{r}/{b}" for b in bin_of.values()], pa.string()), pa.array([size[k] for k in bin_of], pa.int64())], ["_group", "_bin", "bytes"])


def _even(groups: DataFrame, n_shards: int) -> DataFrame:
    """[_group, shard]: n_shards shards of about equal bytes.

    Up to DRIVER_ITEMS groups are packed on the driver. More are dealt by hash over ranges of about RANGE_ITEMS groups, and
    each range is packed by its real sizes into RANGE_BINS bins in one task; the bins are the groups of the next level, and
    so on: real sizes decide at every table size, and no task or driver holds more than so many items.
    A group larger than its range's share has a bin of its own.
    """
    level, levels = reliable(groups), []
    while (n := level.count()) > DRIVER_ITEMS:
        ranges = -(-n // RANGE_ITEMS)
        dealt = level.withColumn("_range", F.pmod(F.xxhash64("_group"), F.lit(ranges))).select("_range", "_group", "bytes")
        packed = reliable(dealt.repartition("_range").sortWithinPartitions("_range").mapInArrow(partial(_packed_evenly, RANGE_BINS), "_group string, _bin string, bytes long"))
        levels.append(packed.select("_group", "_bin"))
        level = packed.groupBy(F.col("_bin").alias("_group")).agg(F.sum("bytes").alias("bytes"))
    items = [(r["_group"], r["bytes"]) for r in level.collect()]
    packed = best_fit_decreasing(items, -(-sum(size for _, size in items) // n_shards), n_shards)
    placed = groups.sparkSession.createDataFrame(list(packed.bin_of.items()), "_group string, shard int")  # DRIVER_ITEMS rows
    for below in reversed(levels):
        placed = below.join(F.broadcast(placed.withColumnRenamed("_group", "_bin")) if below is levels[-1] else placed.withColumnRenamed("_group", "_bin"), "_bin").select("_group", "shard")
    return placed


def shard_by_size(docs: DataFrame, size: Column, group: Column, order: list[Column], n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """docs' columns + shard INT, slot BIGINT (gapless from 0 in each shard).

    Rows of one group stay together. Give n_shards (about equal bytes) or a fixed capacity (no shard is above it but one that holds a single larger group). order breaks ties of slots;
    rows equal in all of it may swap slots. A null group is a group, a null size counts as none; an empty table gives an
    empty result. Input columns named shard or slot are replaced, other names never clash. Texts need not be carried: the
    rows are written once, narrow if docs is; group sizes are pre-aggregated; slots come from counts of SLOT_BUCKETS
    sub-buckets of each shard, so neither a hot group nor a shard meets in one task.
    """
    sub = F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int")
    rows = reliable(docs.select(boxed(docs), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"), F.coalesce(F.sha2(group.cast("string"), 256), F.lit("")).alias("_group"), sub.alias("_sub"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order")))
    groups = rows.groupBy("_group").agg(F.sum("_size").alias("bytes"))
    placed = reliable(_fixed_capacity(groups, capacity) if capacity else _even(groups, n_shards or 1))
    salt = F.pmod(F.xxhash64("_sub"), F.lit(SALT))
    salted = placed.select("_group", "shard", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("_salt"))
    placed_rows = rows.withColumn("_salt", salt).join(salted, ["_group", "_salt"]).drop("_group", "_salt", "_size")
    counts = placed_rows.groupBy("shard", "_sub").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # SLOT_BUCKETS rows a shard
    rank = F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("_order")) - 1
    out = placed_rows.withColumn("_rank", rank).join(before, ["shard", "_sub"])
    return unboxed(out, docs, {"shard": F.col("shard"), "slot": (F.col("_before") + F.col("_rank")).cast("long")})


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size"), text.alias("_text"))
    narrow = docs.withColumn("_key", F.sha2("_text", 256)).drop("_text")
    out = shard_by_size(narrow, F.col("size"), F.col("_key"), [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_key")], n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
