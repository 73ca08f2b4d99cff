"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs no regular expression. Every codepoint gets a class (letter, number, white space, other) from an
array; two codepoints of look-ahead fold white-space runs and contractions into ten symbols; each symbol is a function
on eight automaton states. Those functions form a small monoid whose composition is one table look-up, so a blocked
associative scan over symbols gives the state before every codepoint, and with it the token boundaries of a whole batch.
The slices between boundaries go through a bounded cache to greedy lowest-rank pair merging.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from weftline.llm.common import BOX, boxed, slices, small_batches, unboxed

SEP, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, SPACE_RUN, WHITE_LAST, WHITE_RUN = range(10)
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, PENDING, IN_WHITE, TWO_LEFT, ONE_LEFT = range(8)
#: Unicode White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that the split pattern lists (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
BLOCK = 256
CACHE_ENTRIES = 250_000
#: Bytes of a pre-token from which pairs are kept in a heap, and up to which it is worth a place in the cache.
LONG_PIECE = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this codepoint."""
    if symbol == SEP:
        return FRESH, True
    if symbol == LETTER:
        if state in (TWO_LEFT, ONE_LEFT):
            return (ONE_LEFT if state == TWO_LEFT else FRESH), False
        return IN_LETTER, state not in (IN_LETTER, PENDING)
    if symbol == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, PENDING)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, PENDING):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT}[symbol], True
    if symbol == SPACE_LAST:
        return PENDING, True
    if symbol == WHITE_LAST:
        return IN_WHITE, True
    return IN_WHITE, state != IN_WHITE


class Automaton:
    """The transition monoid: symbols' functions closed under composition, with its product table."""

    def __init__(self) -> None:
        gens = [tuple(_step(s, c)[0] for s in range(8)) for c in range(10)]
        found = {tuple(range(8)): 0}
        todo = list(found)
        for f in todo:
            for g in gens:
                h = tuple(g[x] for x in f)
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
        fs = list(found)
        self.size = len(fs)
        self.of_symbol = np.array([found[g] for g in gens], np.uint16)
        self.product = np.array([[found[tuple(g[x] for x in f)] for g in fs] for f in fs], np.uint16).ravel()
        self.apply = np.array(fs, np.uint8)
        self.starts = np.array([[_step(s, c)[1] for c in range(10)] for s in range(8)])

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive products f0, f0*f1, ... by blocks: inside all blocks at once, then over the blocks' totals."""
        n = len(f)
        if n <= BLOCK:
            out, acc = np.empty_like(f), 0
            for i, x in enumerate(f.tolist()):
                acc = int(self.product[acc * self.size + x])
                out[i] = acc
            return out
        rows = -(-n // BLOCK)
        by_step = np.zeros((rows, BLOCK), np.uint16)
        by_step.ravel()[:n] = f
        by_step = np.ascontiguousarray(by_step.T)
        for j in range(1, BLOCK):
            by_step[j] = self.product[by_step[j - 1].astype(np.int32) * self.size + by_step[j]]
        carry = np.concatenate([[np.uint16(0)], self.scan(by_step[-1])[:-1]]).astype(np.int32)
        return self.product[carry[None, :] * self.size + by_step].T.ravel()[:n]


def _classes() -> np.ndarray:
    """L, N, other or white space (SPACE_LAST for U+0020, else WHITE_LAST) of each codepoint; surrogates are other.

    Letters and numbers are asked once of the engine that reads the split pattern elsewhere, as Unicode versions differ
    between engines; a driver asks, and tasks get the array.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    t = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        engine = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(engine.encode_ordinary(every)).decode()  # what the pattern doesn't match is left out
        t[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    t[WHITE] = WHITE_LAST
    t[0x20] = SPACE_LAST
    return t


_state: dict[str, object] = {}


def _tables(classes: np.ndarray | None = None) -> tuple[Automaton, np.ndarray]:
    if "tables" not in _state:
        _state["tables"] = Automaton(), _classes() if classes is None else classes
    return _state["tables"]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """The texts joined by NUL separators as UTF-8, and the byte offsets at which pre-tokens start, the end included.

    Each separator is a pre-token of its own, so the pre-tokens of text i lie between separators i-1 and i.
    """
    machine, classes = _tables()
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = classes[cp]
    seps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    sym[seps] = SEP
    white = (sym == SPACE_LAST) | (sym == WHITE_LAST)
    run = white & ~np.append((~white & (sym != SEP))[1:], False)  # what follows is white space or the text's end
    apostrophe = np.flatnonzero(cp == 39)
    sym[run] += SPACE_RUN - SPACE_LAST
    ahead = np.append(cp, np.zeros(2, np.uint32))
    one, two = ahead[apostrophe + 1], ahead[apostrophe + 2]
    sym[apostrophe[np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])]] = SHORT
    for c in CONTRACTIONS:
        if len(c) == 2:
            sym[apostrophe[(one == ord(c[0])) & (two == ord(c[1]))]] = LONG
    before = np.empty(len(cp), np.uint8)
    before[0] = FRESH
    before[1:] = machine.apply[machine.scan(machine.of_symbol[sym])[:-1], FRESH]
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.cumsum(width)
    at = np.flatnonzero(machine.starts[before, sym])
    return joined.encode("utf-8", "surrogatepass"), np.append(ends[at] - width[at], ends[-1])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly joins the adjacent pair of lowest rank, the leftmost on ties.

    A short one by a list of its pairs; a long one by a heap of pairs over linked parts, so that a run of letters without
    end takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    far = 1 << 60
    pairs = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == far:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], far)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    stop = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = stop[i]
        if not alive[i] or mid >= n or stop[mid] != end:
            continue  # one of the two has been joined to another since
        stop[i] = end
        alive[mid] = 0
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : stop[end]])) is not None:
                heapq.heappush(heap, (r, i, stop[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    return [ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]


class _Cache(dict):
    """Pre-token to its packed ids; emptied when full, so memory is bounded whatever the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        got = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = got
        return got


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(shared, key: str) -> _Cache:
    if _state.get("key") != key:
        _state["key"], _state["cache"] = key, _Cache(shared.value[0])
        _tables(shared.value[1])
    return _state["cache"]


class Decoder:
    """The vocabulary as one buffer with offsets; ids are decoded by gathering their byte ranges at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        table = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            table[r] = token
        self.width = np.fromiter(map(len, table), np.int64, len(table))
        self.offset = np.cumsum(self.width) - self.width
        self.vocab = np.frombuffer(b"".join(table), np.uint8)

    def texts(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), "<u4")
        w = self.width[ids]
        ends = np.cumsum(w)
        total = int(ends[-1]) if len(ends) else 0
        data = self.vocab[np.arange(total) + np.repeat(self.offset[ids] - (ends - w), w)].tobytes()
        stops = np.cumsum([len(p) // 4 for p in packed])
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], stops])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """All columns + ids (BINARY, little-endian uint32), as ordinary text without special tokens.

    offsets adds piece_ends (BINARY, little-endian uint32): byte offsets at which the pre-tokens end. decoded adds decoded
    (BINARY): the bytes that the ids stand for, decoded where they were made, so that no second Python worker is needed.
    A null or empty text gives no ids; a very long text is encoded whole, in one pass over its classes, and a very long
    pre-token in n log n steps. Rows are independent: copies and ties change nothing; an input column named like an output
    is replaced, other names never clash; an empty table gives an empty result. No shuffle; memory is one batch and a
    bounded cache.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), _tables()[1]))  # a fixed vocabulary, and a byte a codepoint
    rows = small_batches(docs).select(boxed(docs, text_col), F.col(text_col).alias("_text"))
    made = ["ids", *["piece_ends"] * offsets, *["decoded"] * decoded]
    schema = StructType([*rows.schema.fields, *(StructField(c, BinaryType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _encoder(shared, ranks_path)
        decoder = Decoder(shared.value[0]) if decoded else None
        for batch in batches:
            col = batch.column("_text")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
            for i, j in slices(sizes):
                texts = [t or "" for t in col.slice(i, j - i).to_pylist()]
                buf, at = boundaries(texts)
                bounds = at.tolist()
                pieces = [buf[a:b] for a, b in zip(bounds, bounds[1:])]
                row_start = np.concatenate([[0], np.cumsum(sizes[i:j] + 1)])
                first = np.searchsorted(at, row_start)
                ids = [b"".join(map(cache.__getitem__, pieces[a : b - 1])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                out = [batch.column(BOX).slice(i, j - i), col.slice(i, j - i), pa.array(ids, pa.binary())]
                if offsets:
                    out.append(pa.array([(at[a + 1 : b] - s).astype("<u4").tobytes() for a, b, s in zip(first[:-1], first[1:], row_start)], pa.binary()))
                if decoder:
                    out.append(pa.array(decoder.texts(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    out = unboxed(rows.mapInArrow(run, schema), docs, {text_col: F.col("_text")} | {c: F.col(c) for c in made}, text_col)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *made)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns + out_col (BINARY): the bytes that the packed ids stand for. Null ids give an empty value.

    Columns, copies and empty tables as in encode.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    rows = small_batches(encoded).select(boxed(encoded), F.col(ids_col).alias("_ids"))
    schema = StructType([rows.schema[BOX], StructField("_bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            packed = [x or b"" for x in batch.column("_ids").to_pylist()]
            for i, j in slices(np.fromiter(map(len, packed), np.int64, len(packed))):
                yield pa.RecordBatch.from_arrays([batch.column(BOX).slice(i, j - i), pa.array(decoder.texts(packed[i:j]), pa.binary())], schema.names)

    return unboxed(rows.mapInArrow(run, schema), encoded, {out_col: F.col("_bytes")})


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, path, decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
