"""SimHash near-duplicates: fingerprints, BK-trees of shards, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.llm.common import LOWER, boxed, each_text, mix, reliable, shingles, small_batches, stored, table, text_or_empty, unboxed, whole_groups, words_of
from weftline.llm.components import connected_components

SEED = 42
#: Rows of a shard's forest that one search keeps on its frontier.
FRONTIER = 2_000_000
#: Shards' rows that are built into one forest at a time.
FOREST = 500_000
#: 64-bit words of the fingerprints by which near copies of a given similarity are sought.
WORDS = 2
#: Unrelated fingerprints that a shard of those holds on average, and the share of pairs that may share no shard.
SHARD, MISS = 32, 0.01
#: Row numbers, eight bytes each, that are broadcast at most to pick or leave out texts where they lie.
BROADCAST_ROWS = 4_000_000
#: Rows of one side of a cell; a shard of more than two sides is dealt over cells.
SIDE = 256


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: eight packed byte counters at a time, 255 hashes before they are emptied."""
    out = np.zeros(64, np.int64)
    ones = np.uint64(0x0101010101010101)
    at = np.arange(0, len(h), 255)
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & ones, at)
        out[j::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, k: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text's word k-shingles; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist())
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    bits = _bit_counts(h) * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 4) -> DataFrame:
    """keep columns + fp BIGINT (the bits as a signed number). A null text counts as empty: fingerprint zero. No shuffle."""
    rows = small_batches(docs).select(*keep, text_or_empty(text_col).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, k) for t in each_text(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(fp)], [*keep, "fp"])

    return rows.mapInArrow(run, schema)


def _distance(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows a and b; fp has one 64-bit word a row, or several in columns."""
    d = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
    return d if d.ndim == 1 else d.sum(axis=1)


class Forest:
    """BK-trees of many shards at once: each node's children are keyed by their integer Hamming distance to it.

    All rows descend together, one level a step: the first row to reach a (node, distance) edge becomes its child. A row
    that meets a node within absorb bits on its way down stops there and does not enter the tree, so a group of near
    copies takes a few nodes.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray, absorb: int = -1) -> None:
        self.fp, self.span = fp, 64 * (fp.size // max(1, len(fp))) + 1
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))  # shards are contiguous
        self.root = np.repeat(first, np.diff(np.append(first, len(fp))))
        rows = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at = self.root[rows]
        keys, nodes = [], []
        while len(rows):
            d = _distance(fp, rows, at)
            rows, at, d = rows[d > absorb], at[d > absorb], d[d > absorb]
            edge, lead, back = np.unique(at * self.span + d, return_index=True, return_inverse=True)
            keys.append(edge)
            nodes.append(rows[lead])
            rest = np.ones(len(rows), bool)
            rest[lead] = False
            at, rows = rows[lead][back][rest], rows[rest]
        order = np.argsort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        self.keys = np.concatenate(keys)[order] if keys else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes)[order] if nodes else np.empty(0, np.int64)

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, node row) pairs within the radius, a level at a time; only edges within it are followed."""
        todo = [(queries, self.root[queries])]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = _distance(self.fp, q, node)
            hit = d <= radius
            yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
            n = hi - lo
            if n.any():
                ends = np.cumsum(n)
                edge = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
                todo.append((np.repeat(q, n), self.nodes[edge]))


def _least_linked(shard: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its connected part of the shard."""
    forest, lead = Forest(shard, fp), np.arange(len(fp))
    step = 4_096

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = lead[x]
            if (up == x).all():
                return x
            x = up

    for i in range(0, len(fp), step):
        for q, node in forest.near(np.arange(i, min(i + step, len(fp))), radius):
            while len(q):
                a, b = find(q), find(node)
                apart = a != b
                q, node, a, b = q[apart], node[apart], a[apart], b[apart]
                np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
    return find(np.arange(len(fp)))


def _bands(parts: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def link_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links between different fingerprints (fp BIGINT, distinct) that keep every component whole.

    Shards: of radius + m bands at least m stay equal under radius changed bits, so a pair meets in a shard keyed by some
    m bands; m grows with the number of fingerprints, so shards of unrelated ones stay small. In its shard each
    fingerprint walks the shard's BK-tree; links are merged at once and only one to the part's first member leaves the
    task, so a group of copies gives as many links as members, never all pairs. A shard's rows are eight-byte
    fingerprints that agree in m bands and differ elsewhere.
    """
    n = fps.count()
    m = 2
    while n > 64 << (64 * m // (radius + m)) and m < 5:
        m += 1
    bands = _bands(radius + m)
    keys = []
    for i, chosen in enumerate(combinations(range(len(bands)), m)):
        mask = sum(((1 << w) - 1) << at for at, w in (bands[c] for c in chosen))
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))))
    sharded = fps.select("fp", F.explode(F.array(*keys)).alias("shard")).repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "shard", FOREST):
            s, f = np.asarray(held.column("shard")), np.asarray(held.column("fp"))
            same = s[1:] == s[:-1]
            shared = np.append(same, False) | np.append(False, same)
            s, f = s[shared], f[shared]
            if len(s):
                lead = _least_linked(s, f.view(np.uint64), radius)
                linked = lead != np.arange(len(f))
                pair = np.unique(np.stack([f[linked], f[lead[linked]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["a", "b"])

    return sharded.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """[id_col, fp BIGINT, component_id]: documents whose fingerprints link at radius or fewer differing bits, transitively.

    component_id is the smallest id of the component. Equal fingerprints always link, so repeated rows and ties fall in
    one component; null ids are ignored for it unless the whole component has none (then null). Null and empty texts
    have fingerprint zero. Very long texts are read whole; other columns are left out. An empty table gives an empty result. Text never leaves its task: only ids and fingerprints
    are shuffled, and links are sought between distinct fingerprints.
    """
    rows = reliable(fingerprints(docs, text_col, (id_col,), k))
    distinct = reliable(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = reliable(connected_components(link_fingerprints(distinct.select("fp"), radius)))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = reliable(named)
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(of_root, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(id_col, "fp", "component_id")


def _if_small(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; beyond them texts are shuffled to meet it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word k-shingles; a text of fewer words has one, a text of none none."""
    h, row, _, _ = words_of([text])
    return np.unique(shingles(h, row, max(1, min(k, len(h))))[0])


def wide_fingerprint(text: bytes, k: int = 5, words: int = WORDS) -> np.ndarray:
    """A SimHash of 64 * words bits over the set of word k-shingles; each 64-bit word hashes the shingles anew."""
    return _of_shingles(_shingle_set(text, k), words)


def _of_shingles(h: np.ndarray, words: int) -> np.ndarray:
    if not len(h):
        return np.zeros(words, np.uint64)
    with np.errstate(over="ignore"):
        bits = [_bit_counts(mix(h * np.uint64(2 * w + 1) + np.uint64(w * 0x632BE59BD9B4E019 & (1 << 64) - 1))) * 2 > len(h) for w in range(words)]
    return np.concatenate([np.packbits(b, bitorder="little").view("<u8") for b in bits])


def _sampling(n: int, similarity: float) -> tuple[int, int, int]:
    """(bits a shard key samples, number of keys, radius) for n fingerprints and a Jaccard similarity.

    Two sets of that similarity differ in a share p of their bits, the angle between them over pi. Keys sample so many
    bits that about SHARD unrelated fingerprints agree in one, and there are so many keys that a pair at p shares one
    but for MISS. The radius is two standard deviations above the expected distance.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = 64 * WORDS
    sampled = min(48, max(8, math.ceil(math.log2(max(n, 1) / SHARD))))
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - p) ** sampled)))
    return sampled, tables, math.ceil(total * p + 2 * math.sqrt(total * p * (1 - p)))


def _unlinked(cols: dict[str, np.ndarray], masks: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, later row) pairs of a cell that may still be alike: roots differ, and sizes and fingerprints allow the similarity.

    Rows of a cell are contiguous. Of a cell's two sides only pairs across count, on side 2 all. A pair that meets under
    several keys comes only under the first of them, so each pair comes once.
    """
    cell, side, root, size, key, fp = (cols[c] for c in ("cell", "side", "root", "size", "key", "fp"))
    at = np.arange(len(cell))
    ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
    n = ends[np.searchsorted(ends, at, side="right")] - at - 1
    total = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + FRONTIER, side="right")) - 1)
        a = np.repeat(at[i:j], n[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], n[i:j])
        fits = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = a[fits], b[fits]
        fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
        a, b = a[fits], b[fits]
        fits = _distance(fp, a, b) <= radius
        a, b = a[fits], b[fits]
        for k, mask in enumerate(masks):
            first = (key[a] <= k) | ((fp[a] ^ fp[b]) & mask).any(axis=1)
            a, b = a[first], b[first]
        yield a, b
        i = j


def _dealt(rows: np.ndarray, root: np.ndarray, block: int = SIDE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sides, cell numbers) of a large shard: every two rows of different roots meet in a cell of at most two sides.

    Rows of the shard's most frequent root never meet each other, so a large group of known near copies with few others
    gives about one copy of each row.
    """
    _, back, counts = np.unique(root, return_inverse=True, return_counts=True)
    most = back == counts.argmax()
    blocks = [np.array_split(x, -(-len(x) // block)) if len(x) else [] for x in (rows[~most], rows[most])]
    every = [*blocks[0], *blocks[1]]
    for i, left in enumerate(blocks[0]):
        yield left, np.full(len(left), 2, np.int8), np.full(len(left), i * len(every) + i)
        for j in range(i + 1, len(every)):
            both = np.concatenate([left, every[j]])
            yield both, np.repeat(np.array([0, 1], np.int8), [len(left), len(every[j])]), np.full(len(both), i * len(every) + j)


def _links_of_cell(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Of the row pairs (a ascending) those that are alike; pairs that links have joined already are left out."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(ids.astype(np.int32), np.cumsum([len(x) for x in sets])[:-1])
    root, held = root.copy(), np.zeros(len(ids), bool)
    for x in np.unique(a).tolist():
        others = b[a == x]
        others = others[root[others] != root[x]]
        if not len(others):
            continue
        held[of[x]] = True
        ends = np.cumsum([len(of[y]) for y in others])
        hits = np.concatenate([[0], np.cumsum(held[np.concatenate([of[y] for y in others])])])
        held[of[x]] = False
        sizes = np.diff(ends, prepend=0)
        shared = hits[ends] - hits[ends - sizes]
        for y in others[shared >= similarity * (sizes + len(of[x]) - shared)].tolist():
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                yield x, y


def _other_links(fps: DataFrame, rows: DataFrame, links: DataFrame, keys: list, masks: np.ndarray, radius: int, k: int, similarity: float) -> DataFrame:
    """(a, b): links between components of links, so that every pair of a shard within the radius is either joined or known to be unlike.

    Shards are dealt again, now with each row's component; a shard of one component has nothing left. Rows with a pair
    to try go with their texts to the pair's cell (a small shard, or two sides of a large one), where the pairs are held
    to the exact similarity. No pair is ever a row: what leaves a cell is at most a link a row.
    """
    words, block = [f"w{i}" for i in range(WORDS)], SIDE
    roots = connected_components(links).withColumnRenamed("node", "n")
    known = stored(fps.join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")))
    sharded = known.select("n", *words, "size", "root", F.posexplode(F.array(*keys)).alias("key", "shard"))
    out = ["cell", "side", "n", "size", "root", "key", *words]
    schema = "cell long, side byte, n long, size long, root long, key int, " + ", ".join(f"{c} long" for c in words)

    def columns(held: pa.Table, cell: str) -> dict[str, np.ndarray]:
        cols = {c: np.asarray(held.column(c)) for c in held.column_names if c != "text"}
        cols["cell"] = cols[cell]
        cols.setdefault("side", np.full(held.num_rows, 2, np.int8))
        cols["fp"] = np.stack([cols[c] for c in words], axis=1).view(np.uint64)
        return cols

    def batch_of(cols: dict[str, np.ndarray], at: np.ndarray, **changed: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(changed.get(c, cols[c][at] if c not in changed else None)) for c in out], out)

    def to_try(cols: dict[str, np.ndarray]) -> np.ndarray:
        tried = np.zeros(len(cols["cell"]), bool)
        for a, b in _unlinked(cols, masks, radius, similarity):
            tried[a] = tried[b] = True
        return np.flatnonzero(tried)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*out, "large"]
        for held in whole_groups(batches, "shard", FOREST):
            cols = columns(held, "shard")
            starts = np.flatnonzero(np.concatenate([[True], cols["cell"][1:] != cols["cell"][:-1]]))
            sizes = np.diff(np.append(starts, held.num_rows))
            small = np.flatnonzero(np.repeat(sizes <= 2 * block, sizes))
            few = {c: x[small] for c, x in cols.items()}
            batch = batch_of(few, to_try(few))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, bool))], names)
            for at, size in zip(starts[sizes > 2 * block].tolist(), sizes[sizes > 2 * block].tolist()):
                for r, side, number in _dealt(np.arange(at, at + size), cols["root"][at : at + size], block):
                    with np.errstate(over="ignore"):
                        cell = mix(cols["cell"][r].view(np.uint64) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    batch = batch_of(cols, r, cell=cell, side=side)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(len(r), bool))], names)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "cell", FOREST):
            cols = columns(held, "cell")
            yield batch_of(cols, to_try(cols))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "cell", 1):
            cols = columns(held, "cell")
            found = []
            for a, b in _unlinked(cols, masks, radius, similarity):
                cuts = np.flatnonzero(np.diff(cols["cell"][a])) + 1
                for x, y in zip(np.split(a, cuts), np.split(b, cuts)):
                    if len(x):
                        used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                        sets = [_shingle_set(t.encode(), k) for t in held.column("text").take(pa.array(used)).to_pylist()]
                        found += [(used[i], used[j]) for i, j in _links_of_cell(sets, back[: len(x)], back[len(x) :], cols["root"][used], similarity)]
            at = np.array(found, np.int64).reshape(-1, 2)
            ends = cols["n"][at]
            yield pa.RecordBatch.from_arrays([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], ["a", "b"])

    dealt = stored(sharded.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(deal, schema + ", large boolean"))
    large = dealt.filter("large").drop("large").repartition("cell").sortWithinPartitions("cell").mapInArrow(thin, schema)
    cells = stored(dealt.filter("NOT large").drop("large").unionByName(large))
    return rows.join(_if_small(cells, BROADCAST_ROWS // 8), "n").select(*out, "text").repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a long, b long")


def similar_links(docs: DataFrame, id_col: str, text_col: str, k: int = 5, similarity: float = 0.8, among: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of ids (BIGINT, distinct) whose texts have a Jaccard similarity of at least similarity in word k-shingles.

    The links keep every component whole; pairs that others join need not be among them. Candidates come first from the
    BK-trees of shards; a shard holds the fingerprints that agree in a sample of bits. A row takes the earliest tree node
    within the radius of each of its shards, so a group of near copies makes at most one candidate a row and shard and
    never all pairs. Every candidate is held to the exact similarity of the whole texts. That joins most near copies;
    then _other_links tries all pairs within the radius that are not joined yet. What is missed is a pair that shares no
    shard or lies outside the radius: at the similarity itself a chance of some hundredths, closer more rarely. among, a
    table of ids, limits the links to these rows, and no text is moved to tell them.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("n"), text_or_empty(text_col).alias("text"))
    cols = [f"w{i}" for i in range(WORDS)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(len(h), _of_shingles(h, WORDS)) for h in (_shingle_set(t, k) for t in each_text(batch, "text"))]
            size, fp = np.array([x for x, _ in both], np.int64), np.array([x for _, x in both], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["n", "size", *cols])

    fps = rows.mapInArrow(hashed, "n long, size long, " + ", ".join(f"{c} long" for c in cols))
    fps = stored(fps if among is None else fps.join(among.select(F.col(among.columns[0]).alias("n")), "n", "left_semi"))
    sampled, tables, radius = _sampling(fps.count(), similarity)
    rng = np.random.default_rng(SEED)
    keys, all_masks = [], []
    for i in range(tables):
        on = np.zeros(64 * WORDS, bool)
        on[rng.choice(64 * WORDS, sampled, replace=False)] = True
        masks = np.packbits(on, bitorder="little").view("<i8").tolist()
        all_masks.append(masks)
        key = F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(cols, masks)])
        keys.append(key.bitwiseAND(F.lit(~3)).bitwiseOR(F.lit(i % 4)))  # the low bits name the order of the shard's rows
    order = F.expr("IF(shard & 3 = 0, n, xxhash64(n, shard & 3))")
    sharded = fps.select("n", *cols, F.explode(F.array(*keys)).alias("shard")).repartition("shard").withColumn("place", order).sortWithinPartitions("shard", "place").drop("place")

    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "shard", FOREST):
            n, shard = np.asarray(held.column("n")), np.asarray(held.column("shard"))
            fp = np.stack([np.asarray(held.column(c)) for c in cols], axis=1).view(np.uint64)
            forest, best = Forest(shard, fp, radius), np.arange(len(n))
            for i in range(0, len(n), 4_096):
                for q, node in forest.near(np.arange(i, min(i + 4_096, len(n))), radius):
                    np.minimum.at(best, q, node)
            at = np.flatnonzero(best != np.arange(len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(n[at], n[best[at]])), pa.array(np.minimum(n[at], n[best[at]]))], ["a", "b"])

    pairs = stored(sharded.mapInArrow(earliest, "a long, b long").distinct())
    few = _if_small(pairs, BROADCAST_ROWS // 2)
    firsts = rows.join(_if_small(pairs.select(F.col("b").alias("n")).distinct(), BROADCAST_ROWS), "n", "left_semi").select(F.col("n").alias("b"), F.col("text").alias("first"))
    both = rows.withColumnRenamed("n", "a").join(few, "a").join(firsts, "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = b"", _shingle_set(b"", k)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(each_text(batch, "text"), each_text(batch, "first"))):
                if y != known:
                    known, first = y, _shingle_set(y, k)
                one = _shingle_set(x, k)
                shared = len(np.intersect1d(one, first, assume_unique=True))
                keep[i] = shared >= similarity * (len(one) + len(first) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    links = reliable(both.select("a", "b", "text", "first").mapInArrow(alike, "a long, b long"))
    return links.unionByName(_other_links(fps, rows, links, keys, np.array(all_masks, np.int64).view(np.uint64), radius, k, similarity))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without copies and near copies: of each group the row of smallest id stays; all columns as they are.

    Equal texts are one group whatever their length. Groups of different texts are components of similar_links: pairs
    whose word k-shingles have a Jaccard similarity of at least similarity; texts without words are alike. Of rows equal
    in id and text one stays; a null id comes last; null and empty texts are one group. An empty table gives an empty
    result. Very long texts are read whole, other columns pass through whatever their names. Copies are set aside first
    by a 256-bit hash of the text, pre-aggregated, so only different texts are compared.
    """
    rows = stored(docs.select(boxed(docs, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_n")))  # row numbers must not change
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("_n").alias("n"))
    texts_of = rows.select(F.sha2(text_or_empty("text").cast("binary"), 256).alias("key"), rank.alias("rank"))
    reps = reliable(texts_of.groupBy("key").agg(F.min("rank").alias("rank")).select("rank", F.col("rank.n").alias("_rep")))
    roots = reliable(connected_components(similar_links(rows.select("_n", "text"), "_n", "text", k, similarity, reps.select("_rep"))))
    grouped = reps.join(roots, reps["_rep"] == roots["node"]).select("rank", "_rep", "root")
    first = grouped.groupBy("root").agg(F.min("rank").alias("least")).select("root", F.col("least.n").alias("_first"))
    gone = grouped.join(first, "root").filter("_rep <> _first").select("_rep")
    same = rows.select("_n").join(reps.select(F.col("_rep").alias("_n")), "_n", "left_anti")
    left_out = reliable(same.unionByName(gone.select(F.col("_rep").alias("_n"))))
    kept = rows.join(_if_small(left_out, BROADCAST_ROWS), "_n", "left_anti")
    return unboxed(kept, docs, {text_col: F.col("text")}, text_col).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
