"""Files that are one JSON array each, read in byte ranges and written in parts.

A range begins behind a closing brace, so it starts inside a string or outside of one, at some depth. What a range does
to that state is an associative function; its values, one row a range, are stitched in file order. Then each range knows
its start and hands on the elements that begin in it; what a cut leaves of an element is joined to its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import written

_QUOTE, _BACKSLASH, _COMMA, _NEUTRAL = b'"'[0], b"\\"[0], b","[0], b"x"[0]
#: What a byte does to the depth, and whether it can matter to it at all.
_STEP = np.zeros(256, np.int64)
_STEP[[*b"[{"]], _STEP[[*b"]}"]] = 1, -1
_SHAPE = _STEP != 0
_SHAPE[_COMMA] = True


def _place_in_run(mark: np.ndarray) -> np.ndarray:
    """For marked places how many marked ones stand right before, -1 elsewhere."""
    at = np.arange(len(mark))
    return np.where(mark, at - np.maximum.accumulate(np.where(mark, -1, at)) - 1, -1)


def _second_of_pairs(mark: np.ndarray) -> np.ndarray:
    """Places that a marked place before them takes as its second byte; such a place doesn't act as a mark itself."""
    place = _place_in_run(mark)
    out = (place > 0) & (place % 2 == 1)
    out[1:] |= ~mark[1:] & (place[:-1] >= 0) & (place[:-1] % 2 == 0)
    return out


def structure(data: bytes, encoding: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, bytes there, quotes before them mod 2, all quotes mod 2) of brackets, braces and commas; data begins between characters.

    Two-byte codes of GB18030 can end in a bracket, brace or backslash: second bytes don't count.
    """
    b = np.frombuffer(data, np.uint8)
    if encoding == "gb18030":
        b = np.where(_second_of_pairs((b >= 0x81) & (b <= 0xFE)), np.uint8(_NEUTRAL), b)
    quote = b == _QUOTE
    back = b == _BACKSLASH
    if back.any():
        quote &= ~_second_of_pairs(back)
    quotes = np.flatnonzero(quote)
    at = np.flatnonzero(_SHAPE[b])
    return at, b[at], np.searchsorted(quotes, at) & 1, len(quotes) & 1


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """[file BIGINT, start BIGINT, value BINARY]: pieces that end before a closing brace, in order within each byte range."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    file, start = np.asarray(batch.column("file")), np.asarray(batch.column("start"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _joined(part: pa.RecordBatch) -> bytes:
    return b"}".join(part.column("value").to_pylist()) + b"}"


def _effects(ranges: DataFrame, encoding: str) -> DataFrame:
    """[file, start, odd, outside, inside]: whether a range flips being in a string, and its depth change from either state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for key, part in _by_range(batch):
                odd, *depth = held.get(key, [0, 0, 0])
                _, kind, parity, flips = structure(_joined(part), encoding)
                step = _STEP[kind]
                now = [int(step[parity == 0].sum()), int(step[parity == 1].sum())]
                held[key] = [odd ^ flips, depth[0] + now[odd], depth[1] + now[1 - odd]]
        rows = [(*k, *v) for k, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["file", "start", "odd", "outside", "inside"])

    return ranges.mapInArrow(run, "file long, start long, odd long, outside long, inside long")


def _states(effects: DataFrame) -> DataFrame:
    """[file, start, in_string, depth] at the beginning of each range: running compositions over a file's ranges."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    flipped = effects.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    return flipped.withColumn("change", change).select("file", "start", "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))


WHOLE, TAIL, HEAD = 0, 1, 2


def _elements(ranges: DataFrame, encoding: str) -> DataFrame:
    """[file, start, kind, text]: whole elements, a range's last one that goes on in the next (TAIL), and what goes on from ranges before (HEAD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, opened, in_string, depth = None, [], False, 0, 0
        out: list[tuple] = []

        def left() -> None:
            if key is not None and held:
                out.append((*key, TAIL if opened else HEAD, b"".join(held)))

        def ready() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(2)]
            cols += [pa.array([r[2] for r in out], pa.int32()), pa.array([r[3].decode(encoding, "replace") for r in out], pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["file", "start", "kind", "text"])

        for batch in batches:
            for now, part in _by_range(batch):
                if now != key:
                    left()
                    key, held, opened = now, [], False
                    in_string, depth = part.column("in_string")[0].as_py(), part.column("depth")[0].as_py()
                data = _joined(part)
                at, kind, parity, flips = structure(data, encoding)
                live = parity == in_string
                at, kind = at[live], kind[live]
                level = depth + np.cumsum(_STEP[kind])
                begins = (level == 1) & (_STEP[kind] == 1) | (level == 1) & (kind == _COMMA)
                ends = (level == 0) & (_STEP[kind] == -1) | (level == 1) & (kind == _COMMA)
                edge = np.flatnonzero(begins | ends)
                done = 0
                for place, begin, end in zip(at[edge].tolist(), begins[edge].tolist(), ends[edge].tolist()):
                    if end:
                        held.append(data[done:place])
                        out.append((*key, WHOLE if opened else HEAD, b"".join(held)))
                    held, opened, done = [], begin, place + 1
                in_string ^= flips
                depth += int(_STEP[kind].sum())
                if depth > 0:
                    held.append(data[done:])
            yield ready()
        left()
        yield ready()

    return ranges.mapInArrow(run, "file long, start long, kind int, text string")


def elements(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """[text]: the elements of every file under path, a row each, as JSON text in UTF-8. A file must be one JSON array.

    Files are cut as Spark cuts text (spark.sql.files.maxPartitionBytes); a task holds one element and one Arrow batch at
    a time, and only the pieces of elements that lie across a cut are shuffled. Bytes that the encoding doesn't know are
    replaced. The table of range states has one row a range and is broadcast: some 30 bytes for each 128 MB.
    """
    if encoding not in ("utf-8", "gb18030"):
        raise ValueError(f"unknown encoding {encoding!r}; utf-8 or gb18030")
    ranges = _ranges(spark, path)
    states = written(_states(_effects(ranges, encoding)))
    moved = F.raise_error(F.lit("files were cut otherwise on the second pass: set spark.sql.files.minPartitionNum")).cast("long")
    begun = ranges.join(F.broadcast(states), ["file", "start"], "left").withColumn("depth", F.coalesce("depth", moved))  # a row a range
    parts = written(_elements(begun, encoding))
    whole = parts.filter(F.col("kind") == WHOLE).select("text")
    cut = parts.filter(F.col("kind") != WHOLE).withColumn("order", F.struct("start", F.col("kind") == TAIL))
    first = F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))  # two rows a range
    pieces = cut.withColumn("first", first).filter("first IS NOT NULL").groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("order", "text"))).alias("p"))  # one element
    stitched = pieces.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(stitched).withColumn("text", F.trim(F.regexp_replace("text", r"^[\s]+|[\s]+$", ""))).filter("text <> ''")


def records(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8") -> DataFrame:
    """The elements as rows of the schema; an element that is no JSON object is left out."""
    corrupt = "_corrupt_record"
    parsed = elements(spark, path, encoding).select(F.from_json("text", f"{schema}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt}).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col(f"r.{corrupt}").isNull()).select("r.*").drop(corrupt)


def write(values: DataFrame, path: str) -> None:
    """Writes JSON values [value] as files that are one array each; a partition is a file, its rows stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = [f"{mark if i == 0 else ','}{v}" for i, v in enumerate(batch.column(0).to_pylist())]
            if lines:
                mark = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], ["value"])

    values.select(F.col("value").cast("string").alias("value")).filter("value IS NOT NULL").mapInArrow(run, "value string").write.text(path)
