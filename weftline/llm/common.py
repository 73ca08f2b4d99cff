"""Shared pieces of the training-data operators: table access, checkpoints, Arrow batching, token hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on.
CHUNK_BYTES = 512 << 10
#: Rows whose texts are Python objects at one time.
ROWS_AT_ONCE = 256
#: Rows of an Arrow batch between the JVM and Python; whole texts ride in them, so Spark's 10,000 take much memory twice.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one a local session gets a local folder; on a cluster that is an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def reliable(df: DataFrame) -> DataFrame:
    """Eagerly checkpointed in the shared folder, so lineage is cut and lost executors cost nothing."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As reliable, but as a Parquet table: compressed, and later readers take only the columns they need."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Name of the struct that carries a caller's columns through an operator, so that no name of theirs meets one of its own.
BOX = "_in"


def boxed(docs: DataFrame, *without: str) -> Column:
    """The caller's columns, but those named, as one struct column BOX."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return F.struct(*kept or [F.lit(True).alias("_")]).alias(BOX)


def unboxed(df: DataFrame, docs: DataFrame, outputs: dict[str, Column], *without: str) -> DataFrame:
    """docs' columns but those named, out of their box, and the outputs; an input column named like an output gives way to it."""
    kept = [F.col(BOX).getField(c).alias(c) for c in docs.columns if c not in without and c not in outputs]
    return df.select(*kept, *[col.alias(name) for name, col in outputs.items()])


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches set to BATCH_ROWS at most: their memory is held in the JVM and in Python."""
    conf = df.sparkSession.conf
    held = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if held <= 0 or held > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_bucket(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def slices(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about limit bytes; a row longer than that is a run of its own."""
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n + 1
    if first < len(lengths):
        yield first, len(lengths)


def texts(batch: pa.RecordBatch, col: str) -> tuple[list, np.ndarray]:
    """The column's values as bytes (null: empty) and their lengths."""
    got = [b"" if v is None else v for v in batch.column(col).cast(pa.binary()).to_pylist()]
    return got, np.fromiter(map(len, got), np.int64, len(got))


def each_text(batch: pa.RecordBatch, col: str) -> Iterator[bytes]:
    """The column's values as bytes (null: empty), a few rows at a time."""
    values = batch.column(col)
    for i in range(0, len(values), ROWS_AT_ONCE):
        for v in values.slice(i, ROWS_AT_ONCE).cast(pa.binary()).to_pylist():
            yield b"" if v is None else v


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 where a byte belongs to a word: everything but space and 09-0D.
_WORD = np.ones(256, np.uint8)
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _P), ("i", _P_INV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits of a polynomial hash are both usable."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(rows: list[bytes], lower: bool = True, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all words of the rows: (hash, row, start, end in the joined buffer).

    Rows are joined by one newline; a prefix sum of byte * P^position gives every word's hash by one subtraction
    and one multiplication with the inverse power.
    """
    joined = b"\n".join(rows)
    if lower:
        joined = joined.translate(LOWER)
    buf = np.frombuffer(joined, np.uint8)
    if not len(buf):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    is_word = word[buf]
    edges = np.flatnonzero(np.diff(is_word, prepend=np.uint8(0), append=np.uint8(0)))
    start, end = edges[0::2], edges[1::2]
    power, inverse = _power_table(len(buf) + 1)
    prefix = np.empty(len(buf) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1)
    return h, np.searchsorted(ends, start, side="right"), start, end


def word_values(rows: list[bytes], lower: bool = True, word: np.ndarray = _WORD) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows as one binary array, so that Arrow compares their bytes: (words, row, start, end in the joined buffer)."""
    joined = b"\n".join(rows)
    if lower:
        joined = joined.translate(LOWER)
    buf = np.frombuffer(joined, np.uint8)
    is_word = word[buf]
    edges = np.flatnonzero(np.diff(is_word, prepend=np.uint8(0), append=np.uint8(0)))
    start, end = edges[0::2], edges[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    values = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[is_word.view(bool)])])
    ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1)
    return values, np.searchsorted(ends, start, side="right"), start, end


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one row, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * _P + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(s[at]), at


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about that many rows or more in which every group of equal keys is whole; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        k = np.asarray(batch.column(key))
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
        if cut == 0 and np.asarray(held[0].column(key))[0] == k[-1]:
            continue
        ready = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        if cut == 0:
            k = np.asarray(ready.column(key))
            first = int(np.searchsorted(k, batch.column(key)[-1].as_py()))
            yield ready.slice(0, first)
            held = [*ready.slice(first).to_batches(), batch]
        else:
            yield ready
            held = [batch.slice(cut)]
        n = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)
