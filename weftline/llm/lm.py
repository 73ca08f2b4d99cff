"""LM scoring by a hashed maximum-entropy model with class-factored softmax, beside a unigram base.

P(word | history) = P(class | history) * P(group | class, history) * P(word | group). The first two factors are
maximum-entropy softmaxes. The last word, the word before it (a skip feature) and both together are hashed to buckets with
a weight per class; the last word and the skip word, each with the class, to buckets with a weight per group of that
class. Groups split a class into equal shares of its tokens, so a frequent word is a group of its own and the history
decides on it; a rare one takes its smoothed share of its group.

Training is gradient ascent: the texts are dealt over ROUNDS parts, each round sums seen minus expected counts of every
bucket over all tasks that read its part, and takes a step, so each text is used once. The head words are broadcast; all
others are the tail, one class, whose counts are joined by shuffle. The vocabulary and its counts grow with the input
without bound, buckets with the training tokens up to MAX_BUCKETS and the head up to HEAD, so that both can be broadcast.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from weftline.llm.common import BOX, LOWER, ROWS_AT_ONCE, boxed, crc_bucket, mix, reliable, slices, small_batches, stored, table, text_or_empty, texts, unboxed, whole_groups

#: Broadcast words; those of more than WORD_BYTES are held as a digest, so the broadcast has a proven bound.
HEAD, WORD_BYTES = 200_000, 64
#: A rarer word has too little evidence for a class of its own and stays in the tail.
HEAD_COUNT = 5
#: Classes: the end, the word classes, the tail. Groups of each word class.
CLASSES, GROUPS = 16, 16
#: Training tokens a bucket, and the least and most buckets of a table.
BUCKET_TOKENS, MIN_BUCKETS, MAX_BUCKETS = 1 << 13, 1 << 12, 1 << 18
ROUNDS, RATE, DECAY = 4, 0.8, 0.7
#: Pseudo-count that holds a bucket's step back where it has little evidence, and the longest step of one weight.
DAMPING, LONGEST = 60.0, 1.5
SMOOTH = 0.1
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
_BLOCK = 64
#: Packed ids that a task works on at a time, and histories whose softmax is worked out at once.
RUN_BYTES, ROWS = 4 << 20, 1 << 15


@dataclass
class Model:
    """Ids: 0..len(words)-1 the head, then tail (or unknown), end, and the start before a text."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    end_count: int
    class_of: np.ndarray
    group_of: np.ndarray
    in_group: np.ndarray  # log10 P(word | group) by id; 0 for the tail, whose counts are joined
    tail_total: float
    class_bias: np.ndarray  # [CLASSES]
    group_bias: np.ndarray  # [CLASSES, GROUPS]
    class_weights: np.ndarray  # [buckets, CLASSES]
    group_weights: np.ndarray  # [buckets, GROUPS]

    @property
    def denominator(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)

    def log_probabilities(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(w | one, two), for the tail without its word's share."""
        n, c = len(self.words), self.class_of[w]
        key = (one * (n + 3) + two) * CLASSES + c
        order = np.argsort(key)  # equal histories are worked out once
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        stop = np.append(first[1:], len(key))
        out = np.empty(len(w))
        for i in range(0, len(first), ROWS):
            a, b = first[i : i + ROWS], stop[i : i + ROWS]
            history, of_class = np.divmod(key[a], CLASSES)
            one_, two_ = np.divmod(history, n + 3)
            new = np.append(True, history[1:] != history[:-1])
            row = np.cumsum(new) - 1
            by_class = softmax(self.class_bias, self.class_weights, class_features(one_[new], two_[new], len(self.class_weights)))[row, of_class]
            by_group = softmax(self.group_bias[of_class], self.group_weights, group_features(one_, two_, of_class, len(self.group_weights)))
            tokens = order[a[0] : b[-1]]
            of = np.repeat(np.arange(len(a)), b - a)
            out[tokens] = np.log10(np.maximum(by_class[of] * by_group[of, self.group_of[w[tokens]]], 1e-37))
        return out + self.in_group[w]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """[word BINARY, c BIGINT] of all words of all texts, ASCII lower-cased; partial counts leave each task, not words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                for t in texts(batch.slice(i, ROWS_AT_ONCE), "_text")[0]:
                    held.update(t.translate(LOWER).split())
                    if len(held) > HELD_WORDS:
                        yield hand_on()
        if held:
            yield hand_on()

    rows = small_batches(docs).select(text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _short(word: bytes) -> bytes:
    return word if len(word) <= WORD_BYTES else hashlib.sha256(word).digest() + bytes(WORD_BYTES)


def _coded(shared, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as packed int32 word ids with the end's id last, so that later passes split no text, and its tail words."""
    words = shared.value
    ids = {w: i for i, w in enumerate(words)}
    get, n = ids.get, len(words)
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(i, ROWS_AT_ONCE)
            coded, tails = [], []
            for t in texts(part, "_text")[0]:
                ws = t.translate(LOWER).split()
                got = [get(w, n) for w in ws]
                rest = []
                for at, w in [(at, w) for at, (w, x) in enumerate(zip(ws, got)) if x == n]:
                    if len(w) > WORD_BYTES:
                        got[at] = get(_short(w), n)
                    if got[at] == n:
                        rest.append(w)
                got.append(n + 1)
                coded.append(np.array(got, np.int32).tobytes())
                tails.append(rest)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(coded, pa.binary()), pa.array(tails, pa.list_(pa.binary()))], [*keep, "_ids", "_tail"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, packed ids) of runs of a batch's coded texts."""
    rows, sizes = texts(batch, "_ids")
    for a, b in slices(sizes, RUN_BYTES):
        yield a, b, np.frombuffer(b"".join(rows[a:b]), np.int32).astype(np.int64)


def contexts(w: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last word and the word before it of each token; start before a text."""
    one = np.append(start, w[:-1])
    one[one == end] = start
    two = np.append(start, one[:-1])
    two[one == start] = start
    return one, two


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _buckets(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x) & np.uint64(n - 1)).astype(np.int64)


def class_features(one: np.ndarray, two: np.ndarray, n: int) -> list[np.ndarray]:
    a, b = (one.astype(np.uint64) + np.uint64(1)) * _A, (two.astype(np.uint64) + np.uint64(1)) * _B
    return [_buckets(x, n) for x in (a, b + np.uint64(7), a + b)]


def group_features(one: np.ndarray, two: np.ndarray, of_class: np.ndarray, n: int) -> list[np.ndarray]:
    c = (of_class.astype(np.uint64) + np.uint64(1)) * _C
    return [_buckets(x, n) for x in ((one.astype(np.uint64) + np.uint64(1)) * _A + c, (two.astype(np.uint64) + np.uint64(1)) * _B + c + np.uint64(7))]


def softmax(bias: np.ndarray, weights: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    z = weights[feats[0]]
    for f in feats[1:]:
        z += weights[f]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _add(total: np.ndarray, evidence: np.ndarray, f: np.ndarray, p: np.ndarray, times: np.ndarray) -> None:
    """total[f] -= p and evidence[f] += times, each bucket once."""
    order = np.argsort(f)
    g = f[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    total[g[at]] -= np.add.reduceat(p[order], at, axis=0)
    evidence += np.bincount(f, times, minlength=len(evidence))


def _gradient(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's share of seen minus expected counts of every bucket of both tables, with the bucket's tokens as last column."""
    n, class_of, group_of, bias, weights, group_bias, group_weights = shared.value
    size = len(weights)
    by_class, by_group = np.zeros((size, CLASSES)), np.zeros((size, GROUPS))
    class_n, group_n = np.zeros(size), np.zeros(size)
    for batch in batches:
        for _, _, w in _runs(batch):
            one, two = contexts(w, n + 1, n + 2)
            c = class_of[w]
            key = np.sort(((one * (n + 3) + two) * CLASSES + c) * GROUPS + group_of[w])  # equal ones are worked out once
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key))).astype(np.float64)
            outcome = key[first]
            for i in range(0, len(first), ROWS):
                _outcomes(outcome[i : i + ROWS], times[i : i + ROWS], n, (bias, weights, by_class, class_n), (group_bias, group_weights, by_group, group_n))
    for level, (total, evidence) in enumerate(((by_class, class_n), (by_group, group_n))):
        blocks = np.hstack([total, evidence[:, None]]).astype(np.float32).reshape(size // _BLOCK, -1)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array((used * 2 + level).astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "part"])


def _outcomes(outcome: np.ndarray, times: np.ndarray, n: int, classes: tuple, groups: tuple) -> None:
    """Adds the gradients of distinct (last, before, class, group) outcomes, sorted, that occur so many times."""
    in_class, g = np.divmod(outcome, GROUPS)
    new = np.append(True, in_class[1:] != in_class[:-1])
    at = np.flatnonzero(new)
    history, c = np.divmod(in_class[at], CLASSES)
    class_times = np.add.reduceat(times, at)
    one, two = np.divmod(history, n + 3)
    bias, weights, total, evidence = groups
    words = (c > 0) & (c < CLASSES - 1)
    if words.any():
        feats = group_features(one, two, c, len(weights))
        row = np.cumsum(new) - 1
        seen = words[row]
        chosen = [f[words] for f in feats]
        p = softmax(bias[c[words]], weights, chosen) * class_times[words, None].astype(np.float32)
        for f, part in zip(feats, chosen):
            _add(total, evidence, part, p, class_times[words])
            total += np.bincount(f[row[seen]] * GROUPS + g[seen], times[seen], minlength=total.size).reshape(total.shape)
    bias, weights, total, evidence = classes
    new = np.append(True, history[1:] != history[:-1])
    lead = np.flatnonzero(new)
    row = np.cumsum(new) - 1
    each = np.add.reduceat(class_times, lead)
    feats = class_features(one[lead], two[lead], len(weights))
    p = softmax(bias, weights, feats) * each[:, None].astype(np.float32)
    for f in feats:
        _add(total, evidence, f, p, each)
        total += np.bincount(f[row] * CLASSES + c, class_times, minlength=total.size).reshape(total.shape)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches, "block", 1):
        of, parts = np.asarray(group.column("block")), group.column("part").to_pylist()
        for block in np.unique(of):
            total = np.sum([np.frombuffer(parts[i], np.float32).astype(np.float64) for i in np.flatnonzero(of == block)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "part"])


def _gather(rows: DataFrame, shared, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(gradient, tokens of each bucket) of both tables, summed over all tasks; at most MAX_BUCKETS rows each reach the driver."""
    parts = rows.mapInArrow(partial(_gradient, shared), "block int, part binary")
    out = [np.zeros((size // _BLOCK, _BLOCK * (k + 1))) for k in (CLASSES, GROUPS)]
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, part binary").collect():
        out[r["block"] % 2][r["block"] // 2] = np.frombuffer(r["part"])
    return [(x.reshape(size, -1)[:, :-1], x.reshape(size, -1)[:, -1]) for x in out]


def _step(gradient: np.ndarray, tokens: np.ndarray, share: np.ndarray, rate: float) -> np.ndarray:
    """rate * gradient, each weight's scaled by the counts that its bucket expects at the start, and cut to LONGEST."""
    return rate * np.clip(gradient / ((tokens[:, None] + DAMPING) * share), -LONGEST, LONGEST)


def _companions(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word * CLASSES + seed, n): how often each seed word is the last one before a head word."""
    n_head, seeds = shared.value
    for batch in batches:
        for _, _, w in _runs(batch):
            at = np.where(w < seeds, np.arange(len(w)), -1)
            last = np.append(-1, np.maximum.accumulate(at)[:-1])
            ok = (last >= 0) & (w < n_head) & (w >= seeds)
            pair, n = np.unique(w[ok] * CLASSES + w[last[ok]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])


def head_words(vocab: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The HEAD most frequent words (ties: the smaller) and their counts; at most HEAD rows of WORD_BYTES reach the driver."""
    word = F.when(F.octet_length("word") <= WORD_BYTES, F.col("word")).otherwise(F.concat(F.unhex(F.sha2("word", 256)), F.lit(bytes(WORD_BYTES))))
    top = vocab.filter(F.col("c") >= HEAD_COUNT).select("c", word.alias("word")).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    return [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.float64)


def code(docs: DataFrame, words: list[bytes], text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, _part INT, _ids BINARY, _tail ARRAY<BINARY>: every text coded by the head, written to the shared folder."""
    rows = small_batches(docs).select(*keep, F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(ROUNDS)).cast("int").alias("_part"), text_or_empty(text_col).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("_ids", BinaryType()), StructField("_tail", ArrayType(BinaryType()))])
    return stored(rows.mapInArrow(partial(_coded, docs.sparkSession.sparkContext.broadcast(words), [*keep, "_part"]), schema))


def _classes(coded: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Class by id: 0 the end, 1..CLASSES-2 the seed words with their companions, the last the tail."""
    n, seeds = len(counts), min(len(counts), CLASSES - 2)
    class_of = np.full(n + 3, CLASSES - 1, np.int64)
    class_of[n + 1] = 0
    class_of[:seeds] = np.arange(seeds) + 1
    if n > seeds:
        pairs = coded.mapInArrow(partial(_companions, coded.sparkSession.sparkContext.broadcast((n, seeds))), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        share = counts[:seeds] / counts[:seeds].sum()
        weight = F.create_map(*[x for s in range(seeds) for x in (F.lit(s), F.lit(float(share[s])))])
        by_word = pairs.select(F.floor(F.col("pair") / CLASSES).alias("w"), (F.col("pair") % CLASSES).cast("int").alias("s"), "n")
        whole = by_word.groupBy("w").agg(F.sum("n").alias("all"), F.collect_list(F.struct("s", "n")).alias("l"))  # at most one entry a seed
        best = whole.select("w", "all", F.inline("l")).groupBy("w").agg(F.max_by("s", F.struct(F.col("n") - F.col("all") * weight[F.col("s")], -F.col("s"))).alias("s"))
        for r in best.collect():  # at most HEAD rows
            class_of[r["w"]] = r["s"] + 1
        alone = np.flatnonzero(class_of[:n] == CLASSES - 1)
        class_of[alone] = 1 + alone % seeds
    return class_of


def _groups(counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Group by id: each class in GROUPS about equal shares of its tokens, the most frequent words first."""
    out = np.zeros(len(class_of), np.int64)
    for c in range(1, CLASSES - 1):
        mine = np.flatnonzero(class_of[: len(counts)] == c)  # in falling order of their counts
        if len(mine):
            before = np.cumsum(counts[mine]) - counts[mine] / 2
            out[mine] = np.minimum((before / counts[mine].sum() * GROUPS).astype(np.int64), GROUPS - 1)
    return out


def train(coded: DataFrame, vocab: DataFrame, words: list[bytes], counts: np.ndarray) -> Model:
    """The model from the coded rows and the vocabulary of the same texts; learns from every row."""
    n, n_docs = len(words), coded.count()
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    class_of = _classes(coded, counts)
    group_of = _groups(counts, class_of)
    total, distinct = int(total) + n_docs, int(distinct) + (n_docs > 0)
    cell = class_of[:n] * GROUPS + group_of[:n]
    mass, members = np.bincount(cell, counts, minlength=CLASSES * GROUPS), np.bincount(cell, minlength=CLASSES * GROUPS)
    in_group = np.zeros(n + 3)
    in_group[:n] = np.log10((counts + SMOOTH) / (mass + SMOOTH * members)[cell])
    tail = total - n_docs - counts.sum()
    prior = mass.reshape(CLASSES, GROUPS).sum(axis=1)
    prior[0], prior[-1] = n_docs, tail
    prior = (prior + SMOOTH) / (prior + SMOOTH).sum()
    shares = (mass + SMOOTH * (members > 0)).reshape(CLASSES, GROUPS)
    shares[[0, -1]] = 0
    shares[shares.sum(axis=1) == 0, 0] = 1.0  # a class without words has one certain group
    shares /= shares.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        bias, group_bias = np.log(prior).astype(np.float32), np.log(shares).astype(np.float32)
    size = int(min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << max(0, (total // BUCKET_TOKENS)).bit_length())))
    weights, group_weights = np.zeros((size, CLASSES), np.float32), np.zeros((size, GROUPS), np.float32)
    used = np.where(prior[:, None] > 0, shares, 0)[1:-1]
    typical = np.maximum(used.mean(axis=0), 1e-3) if used.any() else np.ones(GROUPS)
    for r in range(ROUNDS if n_docs else 0):
        shared = coded.sparkSession.sparkContext.broadcast((n, class_of, group_of, bias, weights, group_bias, group_weights))
        (g0, t0), (g1, t1) = _gather(coded.filter(F.col("_part") == r).select("_ids"), shared, size)
        rate = RATE * DECAY**r
        weights = (weights + _step(g0, t0, np.maximum(prior, 1e-3), rate)).astype(np.float32)
        group_weights = (group_weights + _step(g1, t1, typical, rate)).astype(np.float32)
    return Model(words, counts, total, distinct, n_docs, class_of, group_of, in_group, float(tail + SMOOTH * (distinct - (n_docs > 0) - n + 1)), bias, group_bias, weights, group_weights)


def _score(shared, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m: Model = shared.value
    n = len(m.words)
    base_of = np.zeros(n + 2)
    base_of[:n] = np.log10((m.counts + SMOOTH) / m.denominator)
    base_of[n], base_of[n + 1] = -np.log10(m.denominator), np.log10((m.end_count + SMOOTH) / m.denominator)
    for batch in batches:
        for a, b, w in _runs(batch):
            log_p = m.log_probabilities(w, *contexts(w, n + 1, n + 2))
            log_p[w == n] -= np.log10(m.tail_total)
            stops = np.flatnonzero(w == n + 1) + 1
            starts = np.append(0, stops[:-1])
            known = np.add.reduceat((w < n) | ((w == n + 1) & (m.end_count > 0)), starts, dtype=np.int64)
            part = batch.slice(a, b - a)
            mine = [pa.array(stops - starts), pa.array(known), pa.array(np.add.reduceat(base_of[w], starts)), pa.array(np.add.reduceat(log_p, starts))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *mine], [*keep, "n_tokens", "n_known", "base_score", "score"])


def score_coded(coded: DataFrame, model: Model, vocab: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep columns + the scores of rows that code() wrote with a row number _row."""
    shared = coded.sparkSession.sparkContext.broadcast(model)  # HEAD words and two tables of MAX_BUCKETS rows at most
    schema = StructType([*(coded.schema[c] for c in keep), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    head = coded.select(*keep, "_ids").mapInArrow(partial(_score, shared, list(keep)), schema)
    words = coded.select("_row", F.explode("_tail").alias("word")).groupBy("word", "_row").agg(F.count("*").alias("k"))
    found = words.join(vocab, "word", "left").select("_row", (F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("l"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("k"))
    tails = found.groupBy("_row").agg(F.sum("l").alias("_l"), F.sum("k").alias("_k"))
    return head.join(tails, "_row", "left").select(
        *[c for c in keep if c != "_row"],
        "n_tokens",
        (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_l", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_l", F.lit(0.0))).alias("score"),
    )


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the vocabulary [word, c]; learns from every row. Null and empty texts are one end token each."""
    vocab = reliable(count_words(docs, text_col))
    words, counts = head_words(vocab)
    return train(code(docs, words, text_col), vocab, words, counts), vocab


def score(docs: DataFrame, model: Model, vocab: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but text_col + n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE (log10 probabilities).

    A null or empty text is its end token alone. Very long texts are coded in one piece and scored whole. Rows are told
    apart by a row number that is written with them, so null and repeated ids do no harm. Input columns that are named
    like an output are replaced by it; other names never clash. An empty table gives an empty result.
    """
    rows = docs.select(boxed(docs, text_col), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    out = score_coded(code(rows, model.words, "_text", (BOX, "_row")), model, vocab, (BOX, "_row"))
    return unboxed(out, docs, {c: F.col(c) for c in ("n_tokens", "n_known", "base_score", "score")}, text_col)


def _held_out(id_col: str) -> Column:
    return crc_bucket(id_col, 10) == 0


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out("doc_id").alias("held_out"))
    vocab = reliable(count_words(docs.filter("NOT held_out")))
    words, counts = head_words(vocab)
    coded = code(docs.withColumn("_row", F.monotonically_increasing_id()), words, keep=("doc_id", "held_out", "_row"))
    model = train(coded.filter("NOT held_out"), vocab, words, counts)
    out = score_coded(coded, model, vocab, ("doc_id", "held_out", "_row"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
