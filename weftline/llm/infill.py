"""Fill-in-the-middle transformation by piece tables: documents are descriptors over buffers that are never changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from weftline.llm.common import _WORD, BOX, boxed, each_text, small_batches, table, text_or_empty, unboxed

#: The marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The buffers that a descriptor can point into.
TEXT, MARKS = 0, 1
#: The order in which prefix (0), suffix (1) and middle (2) are written, each behind its mark. The form `plain` has no marks.
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
FIM_RATE, SPM_RATE, SEED = 50, 80, 42

Piece = tuple[int, int, int]


class PieceTable:
    """A document as (buffer, start, length) descriptors. Edits move descriptors; no buffer is copied or written."""

    def __init__(self, *buffers: bytes):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces: list[Piece] = [(TEXT, 0, len(buffers[TEXT]))]

    def cut(self, offsets: list[int]) -> PieceTable:
        """Splits descriptors at these offsets of the document, ascending: one more descriptor a cut, so equal cuts leave an empty one."""
        out, at, i = [], 0, 0
        for buffer, start, length in self.pieces:
            done = 0
            while i < len(offsets) and offsets[i] <= at + length:
                k = offsets[i] - at
                out.append((buffer, start + done, k - done))
                done, i = k, i + 1
            out.append((buffer, start + done, length - done))
            at += length
        self.pieces = out
        return self

    def arrange(self, order: tuple[int, ...]) -> PieceTable:
        self.pieces = [self.pieces[i] for i in order]
        return self

    def mark(self, marks: list[Piece]) -> PieceTable:
        """One mark's descriptor before each piece."""
        self.pieces = [p for pair in zip(marks, self.pieces, strict=True) for p in pair]
        return self

    def unmark(self) -> PieceTable:
        self.pieces = self.pieces[1::2]
        return self

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def text(self) -> bytes:
        return b"".join(self.stream())

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(i) for i in range(len(order)))


#: Prefix, middle, suffix as they stand in the text, to prefix, suffix, middle; its own inverse.
_READING = (0, 2, 1)


def unit_ends(data: bytes) -> np.ndarray:
    """Byte offsets where units end: a word with the white space before it, or white space that no word follows."""
    word = _WORD[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero((word[:-1] == 1) & (word[1:] == 0)) + 1
    return np.append(ends, len(data)) if len(data) else ends


def marks_of(sentinels: tuple[str, ...]) -> tuple[bytes, list[Piece]]:
    """The marks' buffer and one descriptor a mark. Marks between pieces that hold none can then always be found again."""
    raw = [s.encode() for s in sentinels]
    if len(set(raw)) < 3 or not all(raw) or any(a[:1] in b[1:] for a in raw for b in raw):
        raise ValueError(f"three different sentinels are needed, and no sentinel's first byte again in any: {sentinels}")
    starts = np.cumsum([0, *map(len, raw)]).tolist()
    return b"".join(raw), [(MARKS, s, len(r)) for s, r in zip(starts, raw)]


def draws(doc_id: str, seed: int) -> list[int]:
    """Four unsigned 32-bit draws of a row."""
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(data: bytes, doc_id: str, marks: tuple[bytes, list[Piece]], fim_rate: int, spm_rate: int, seed: int) -> tuple[PieceTable, int, str, list[int]]:
    """(table, units, form, byte offsets of both cuts) of one text."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    held = PieceTable(data, marks[0])
    if not data or h3 % 100 >= fim_rate or any(marks[0][s : s + k] in data for _, s, k in marks[1]):
        return held, n, "plain", []
    form = "spm" if h4 % 100 < spm_rate else "psm"
    cuts = [int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    held.cut(cuts).arrange(_READING).arrange(FORMS[form]).mark([marks[1][i] for i in FORMS[form]])
    return held, n, form, cuts


def put_back(output: bytes, form: str, marks: tuple[bytes, list[Piece]]) -> PieceTable:
    """The text as descriptors over the output: cut at the marks, marks left out, pieces in the inverse order."""
    held = PieceTable(output, marks[0])
    if form == "plain":
        return held
    cuts, at = [], 0
    for i in FORMS[form]:
        _, start, length = marks[1][i]
        at = output.index(marks[0][start : start + length], at)
        cuts += [at, at + length]
        at += length
    return held.cut(cuts[1:]).unmark().arrange(inverse(FORMS[form])).arrange(_READING)


def _characters(part: memoryview) -> int:
    b = np.frombuffer(part, np.uint8)
    return int(np.count_nonzero((b & 0xC0) != 0x80))


_PIECE = StructType([StructField("buffer", IntegerType(), False), StructField("start", LongType(), False), StructField("length", LongType(), False)])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All columns + n_units BIGINT, form STRING, pieces ARRAY<STRUCT<buffer, start, length>>, prefix_chars, middle_chars
    BIGINT, output STRING, output_sha256 STRING.

    fim_rate of 100 texts are cut at two unit ends drawn from the row's id and seed; spm_rate of 100 of these are
    written suffix first (`spm`), the others prefix first (`psm`). All others stay as they are (`plain`): so do empty
    texts and those that hold a sentinel, which could not be told from a mark. pieces are byte ranges of the text
    (buffer 0) and of the sentinels in a row (buffer 1), in the output's order; prefix_chars and middle_chars count
    code points and are null if plain.

    A null text counts as empty and a null id as the empty id. Rows are independent: repeated rows get equal results,
    there are no ties. Very long texts are one buffer, read once and streamed into the hash. Input columns named like
    an output are replaced, other names never clash. An empty table gives an empty result. No shuffle.
    """
    marks = marks_of(sentinels)
    rows = small_batches(docs).select(boxed(docs), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), text_or_empty(text_col).alias("_text"))
    out = [("n_units", LongType()), ("form", StringType()), ("pieces", ArrayType(_PIECE, False)), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", BinaryType()), ("output_sha256", StringType())]
    schema = StructType([rows.schema[BOX], *[StructField(name, kind) for name, kind in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.list_(pa.field("element", pa.struct([pa.field("buffer", pa.int32(), False), pa.field("start", pa.int64(), False), pa.field("length", pa.int64(), False)]), False))
        kinds = [pa.int64(), pa.string(), piece, pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            made: list[list] = [[] for _ in out]
            for doc_id, data in zip(batch.column("_id").to_pylist(), each_text(batch, "_text")):
                held, n, form, cuts = arranged(data, doc_id, marks, fim_rate, spm_rate, seed)
                whole = memoryview(data)
                chars = [_characters(whole[: cuts[0]]), _characters(whole[cuts[0] : cuts[1]])] if cuts else [None, None]
                pieces = [dict(zip(("buffer", "start", "length"), p)) for p in held.pieces]
                for column, value in zip(made, (n, form, pieces, *chars, held.text(), held.sha256())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(BOX), *[pa.array(v, k) for v, k in zip(made, kinds)]], schema.names)

    text = {"output": F.col("output").cast("string")}
    return unboxed(rows.mapInArrow(run, schema), docs, {name: text.get(name, F.col(name)) for name, _ in out})


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All columns + restored STRING, restored_sha256 STRING: the text, from the output and its form alone.

    A null output counts as empty, a null form as plain; an output without the marks of its form raises an error. Rows
    are independent; names, long texts and empty tables as in transform. No shuffle.
    """
    marks = marks_of(sentinels)
    rows = small_batches(outputs).select(boxed(outputs), text_or_empty(output_col).alias("_text"), F.coalesce(F.col(form_col), F.lit("plain")).alias("_form"))
    schema = StructType([rows.schema[BOX], StructField("restored", BinaryType()), StructField("restored_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = [], []
            for form, data in zip(batch.column("_form").to_pylist(), each_text(batch, "_text")):
                held = put_back(data, form, marks)
                texts.append(held.text())
                hashes.append(held.sha256())
            yield pa.RecordBatch.from_arrays([batch.column(BOX), pa.array(texts, pa.binary()), pa.array(hashes, pa.string())], schema.names)

    return unboxed(rows.mapInArrow(run, schema), outputs, {"restored": F.col("restored").cast("string"), "restored_sha256": F.col("restored_sha256")})


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), d AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM u
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
