"""License scans with a positional index of rare licence words, exact verification of key phrases and places."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weftline.llm.common import BOX, boxed, slices, small_batches, table, text_or_empty, texts, unboxed, word_values

#: 1 where a byte of lower-cased text belongs to a word: digits, a to z, and every byte of a code point above 7F.
_LICENCE_WORD = np.zeros(256, np.uint8)
_LICENCE_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Words of a template that are looked up in the index, the rarest first. One would do: the others only thin out candidates.
LOOKUPS = 3
#: Least part of a template's words that must stand at their places.
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """A licence notice: its words, and the key phrase in it that must stand whole. whole: nothing may differ."""

    label: str
    text: str
    key: str = ""
    whole: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> list[int]:
        """Places of the key phrase in the template; all of it if there is none."""
        words, key = self.words, self.key.split()
        if not key:
            return list(range(len(words)))
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return list(range(at, at + len(key)))

    @property
    def need(self) -> int:
        n = len(self.words)
        return n if self.whole or not self.key else max(len(self.key_places), math.ceil(SHARE * n))


#: Phrases and labels that every scan reports.
BASE = (
    Template("gpl", "gnu general public license", whole=True),
    Template("apache", "apache license", whole=True),
    Template("cc-by", "cc by", whole=True),
    Template("mit", "mit license", whole=True),
)
#: Opening words of public licence notices, with the phrase in each that tells it from others.
NOTICES = (
    Template("agpl", "gnu affero general public license", whole=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "creative commons zero", whole=True),
    Template("epl", "eclipse public license", whole=True),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("lgpl", "gnu lesser general public license", whole=True),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)
TEMPLATES = BASE + NOTICES


def _vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _scanned(rows: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary number or -1, row) of every word; Arrow compares the words' bytes."""
    words, row, _, _ = word_values(rows, True, _LICENCE_WORD)
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), row


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """Documents that hold each licence word, over all rows; as many values reach the driver as the templates have words."""
    vocabulary = _vocabulary(templates)
    schema = "word int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(vocabulary, pa.large_string()).cast(pa.large_binary())
        n = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, lengths = texts(batch, "text")
            for a, b in slices(lengths):
                word, row = _scanned(data[a:b], values)
                known = np.flatnonzero(word >= 0)
                n += np.bincount(np.unique(row[known] * len(vocabulary) + word[known]) % len(vocabulary), minlength=len(vocabulary))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found])], ["word", "n"])

    counts = small_batches(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
    return {vocabulary[r["word"]]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Index:
    """Postings of the templates' rarest key words: for each template, places in it from the highest IDF down."""

    templates: tuple[Template, ...]
    lookups: tuple[tuple[int, ...], ...]


def build_index(frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """IDF falls with the document frequency, so the rarest key word comes first; equal ones go by place."""
    rarest = [sorted(t.key_places, key=lambda p: (frequencies.get(t.words[p], 0), p))[:LOOKUPS] for t in templates]
    return Index(templates, tuple(map(tuple, rarest)))


def places(rows: list[bytes], index: Index, vocabulary: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(words a row, then row, template, start in words, words at their places) of every place that holds a template.

    A template's rarest key word proposes starts by its places in the file; the next rarest ones must stand at the same
    relative place. What is left is held to the whole key phrase and to the number of words.
    """
    word, row = _scanned(rows, vocabulary)
    n_words = np.bincount(row, minlength=len(rows))
    first = np.cumsum(n_words) - n_words
    of = np.argsort(word, kind="stable")
    bounds = np.searchsorted(word[of], np.arange(len(numbers) + 1))
    out: list[tuple[np.ndarray, ...]] = []
    for t, (template, lookups) in enumerate(zip(index.templates, index.lookups)):
        ids = np.array([numbers[w] for w in template.words], np.int64)
        m, w0 = len(ids), numbers[template.words[lookups[0]]]
        start = of[bounds[w0] : bounds[w0 + 1]] - lookups[0]
        # The text need not hold the words around the key phrase, so a place may begin before it or go on behind it.
        at = row[start + lookups[0]]
        low, high = first[at], first[at] + n_words[at]

        def stands(place: int, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            p = start + place
            inside = (p >= low) & (p < high)
            return inside & (word[np.where(inside, p, 0)] == ids[place])

        for place in [*lookups[1:], *[p for p in template.key_places if p not in lookups]]:
            if not len(start):
                break
            keep = stands(place, start, low, high)
            start, at, low, high = start[keep], at[keep], low[keep], high[keep]
        if len(start):
            matched = sum(stands(p, start, low, high).astype(np.int64) for p in range(m))
            keep = matched >= template.need
            out.append((at[keep], np.full(int(keep.sum()), t), (start - low)[keep], matched[keep]))
    if not out:
        none = np.empty(0, np.int64)
        return n_words, none, none, none, none
    r, t, s, k = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((t, s, r))
    return n_words, r[order], t[order], s[order], k[order]


_PLACE = StructType([StructField("label", StringType(), False), StructField("start", LongType(), False), StructField("matched", LongType(), False), StructField("n", LongType(), False)])


def scan(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """All columns + n_words BIGINT, places ARRAY<STRUCT<label, start, matched, n>>: every place of a template, by start.

    start is the word (from 0) where the template's first word stands or would stand; it may be negative where a notice's
    opening words before its key phrase are cut off. matched of the template's n words stand at their places.

    A null text counts as empty and has no words. Rows are independent: repeated rows get equal results, and places of
    equal start go by the templates' order. Very long texts are scanned whole. Input columns named like an output are
    replaced, other names never clash. An empty table gives an empty result. No shuffle; the index is a few hundred words.
    """
    rows = small_batches(docs).select(boxed(docs), text_or_empty(text_col).alias("_text"))
    schema = StructType([rows.schema[BOX], StructField("n_words", LongType()), StructField("places", ArrayType(_PLACE, False))])
    names = _vocabulary(index.templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(names, pa.large_string()).cast(pa.large_binary())
        numbers = {w: i for i, w in enumerate(names)}
        labels = pa.array([t.label for t in index.templates], pa.string())
        sizes = np.array([len(t.words) for t in index.templates], np.int64)
        for batch in batches:
            data, lengths = texts(batch, "_text")
            n_words, found = [], [(np.empty(0, np.int64),) * 4]
            for a, b in slices(lengths):
                n, r, t, s, k = places(data[a:b], index, vocabulary, numbers)
                n_words.append(n)
                found.append((r + a, t, s, k))
            r, t, s, k = (np.concatenate(x) for x in zip(*found))
            fields = [pa.field("label", pa.string(), False), *[pa.field(x, pa.int64(), False) for x in ("start", "matched", "n")]]
            each = pa.StructArray.from_arrays([labels.take(pa.array(t)), pa.array(s), pa.array(k), pa.array(sizes[t])], fields=fields)
            ends = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), each, type=pa.list_(pa.field("element", each.type, False)))
            yield pa.RecordBatch.from_arrays([batch.column(BOX), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), lists], schema.names)

    return unboxed(rows.mapInArrow(run, schema), docs, {"n_words": F.col("n_words"), "places": F.col("places")})


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, build_index(document_frequencies(docs)))
    base = [t.label for t in BASE]
    starts = F.transform(F.filter("places", lambda p: p["label"].isin(base)), lambda p: p["start"])
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["matched"] / p["n"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.filter(labels, lambda x: x.isin(base)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _template_rows() -> str:
    rows = [(i, t.label, t in BASE, p, w, p in t.key_places, len(t.key_places), t.need, len(t.words)) for i, t in enumerate(TEMPLATES) for p, w in enumerate(t.words)]
    return ", ".join(f"({i}, '{label}', {str(base).lower()}, {p}, '{w}', {str(key).lower()}, {k}, {need}, {n})" for i, label, base, p, w, key, k, need, n in rows)


OP11_SQL = rf"""
WITH template(t, label, base, place, word, is_key, n_key, need, n) AS (VALUES {_template_rows()}
), d AS (
  SELECT row_number() OVER () AS rn, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT rn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d
), p AS (
  SELECT rn, t, label, base, n, CAST(pos - place AS BIGINT) AS start, count(*) AS matched
  FROM w JOIN template USING (word) GROUP BY rn, t, label, base, n, need, n_key, pos - place
  HAVING count(*) >= need AND count(*) FILTER (WHERE is_key) = n_key
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, count(p.t) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(matched / n), 0.0) AS score
FROM d LEFT JOIN p ON d.rn = p.rn GROUP BY d.rn, d.doc_id, d.words
"""
