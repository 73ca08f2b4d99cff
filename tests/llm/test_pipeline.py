"""The pipeline against a plain version of each stage, and operators on clashing names, long texts and empty tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from weftline.llm import bpe, decontaminate, html, langid, lines, lm, sharding, simhash, substrings
from weftline.llm.common import crc_bucket


def plain_tiles(text, item, k=5):
    """Greedy string tiling by looking at every start in both, the longest free match first."""
    used_i, used_j, total = [False] * len(item), [False] * len(text), 0
    k = min(k, len(item))
    while k:
        best = (0, 0, 0)
        for j in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not used_i[i + n] and not used_j[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            break
        n, i, j = best
        used_i[i : i + n], used_j[j : j + n] = [True] * n, [True] * n
        total += n
    return total / len(item) if item else 0.0


def tokens(t):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", t.lower())


def near_groups(docs, k=5, share=0.8):
    """The smallest id of each group of texts alike in k-word shingles."""
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in docs]
    lead = {i: i for i, _ in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x == y or len(x & y) >= share * len(x | y):
                p, q = find(i), find(j)
                lead[max(p, q)] = min(p, q)
    return {find(i) for i, _ in sets}


def test_tiles_equal_the_plain_search():
    import random

    import numpy as np

    rnd = random.Random(4)
    for _ in range(60):
        item = [rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 30))]
        text = []
        for _ in range(4):
            a = rnd.randrange(len(item))
            text += item[a : a + rnd.randrange(1, 12)] + [rnd.choice("abcxyz") for _ in range(rnd.randrange(3))]
        bench = decontaminate.Benchmark([" ".join(item)], 5)
        h, row, _, _ = decontaminate.words_of([" ".join(text).encode()], False, decontaminate._ALNUM)
        got = sum(sum(t[0] for t in decontaminate.tile(runs, k, len(item))) for _, _, k, runs in bench.runs(h, row)) / len(item)
        assert got == pytest.approx(plain_tiles(text, item))
    long = decontaminate.Benchmark(["a " * 60], 5)
    h, row, _, _ = decontaminate.words_of([b"a " * 100_000], False, decontaminate._ALNUM)
    (_, _, k, runs), *_ = long.runs(h, row)
    assert sum(t[0] for t in decontaminate.tile(runs, k, 60)) == 60 and isinstance(runs, np.ndarray)


def test_pipeline_equals_the_plain_stages(spark):
    import tiktoken

    import corpus_pipeline
    import public_tokenizers as P

    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = source.toPandas()
    model = langid.fit(source.filter(crc_bucket("doc_id", 4) != 2))
    compressors = langid._compressors(model)
    kept = []
    for r in docs.itertuples():
        sizes = sorted(langid.sizes_of(r.text or "", compressors))
        if any(map(str.isalpha, r.text or "")) and (sizes[1] - sizes[0]) / sizes[1] >= langid.MIN_MARGIN:
            kept.append((r.doc_id, r.text))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", kept)
    lined = con.execute(lines.OP1_SQL).df()
    text = dict(zip(lined.doc_id.tolist(), lined.text.tolist()))
    first = near_groups(sorted(text.items()))
    items = [tokens(t) for t in spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas().text]
    clean = {i for i in first if not any(set(x) & set(tokens(text[i])) and plain_tiles(tokens(text[i]), x) >= 0.8 for x in items if " ".join(x[:5]) in " ".join(tokens(text[i])) or len(set(x) & set(tokens(text[i]))) > 0.5 * len(set(x)))}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == clean
    path = P.path("byte_bpe_multi_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for i, r in got.items():
        ids = theirs.encode_ordinary(text[i])
        assert r["text"] == text[i] and r["n_tokens"] == len(ids) and r["round_trip"]
        assert bytes(r["ids"]) == b"".join(x.to_bytes(4, "little") for x in ids)


ODD = [(1, "", "x", "src", None), (2, None, None, None, 3), (None, "some words stand here for once in a while", None, "src", 1), (4, "a b c", "en", "src", 1), (4, "a b c", "en", "src", 1), (5, "é " * 60_000, None, None, None), (6, "w" * 200_000, "en", "x", 9)]


def test_stages_on_odd_rows_and_an_empty_table(spark):
    import corpus_pipeline

    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.filter("false"), SMALL).count() == 0, name
        out = stage(spark, odd, SMALL)
        assert set(odd.columns) <= set(out.columns) and out.count() <= len(ODD), name
        if name == "line_dedup":
            assert out.count() == len(ODD)
        if name == "simhash_near_dedup":
            assert sorted(str(r["doc_id"]) for r in out.select("doc_id").collect()) == ["1", "4", "5", "6", "None"]


def test_names_never_clash(spark):
    import public_tokenizers as P

    mine = "_in _text _row _part _ids _tail _key _id _n _group _size _order _sub id key ids score n_tokens shard slot lang_pred kept removed n_bytes at line hit html".split()
    rows = [(1, "one two three four five six", *mine), (2, "one two three four five seven", *mine)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in mine))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    model, vocab = lm.fit(df)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    outputs = {
        "encode": (bpe.encode(df, path), {"ids"}, set()),
        "identify": (langid.identify(df, []), {"lang_pred"}, set()),
        "lines": (lines.dedup_lines(df), set(), set()),
        "score": (lm.score(df, model, vocab), {"score", "n_tokens"}, {"text"}),
        "substrings": (substrings.dedup_substrings(df), {"kept", "removed", "n_bytes"}, {"text"}),
        "one_of_each": (simhash.one_of_each(df), set(), set()),
        "shards": (sharding.shard_by_size(df, F.lit(1), F.col("text"), [F.col("doc_id")], n_shards=2), {"shard", "slot"}, set()),
        "extract": (html.extract(df, "text", "text"), set(), set()),
        "clean": (decontaminate.clean(df, bench.filter("false")), set(), set()),
    }
    for name, (out, replaced, gone) in outputs.items():
        got = out.orderBy("doc_id").collect()
        assert len(got) == 2 and len(set(out.columns)) == len(out.columns), name
        for c in set(mine) - replaced:
            assert [r[c] for r in got] == [c, c], (name, c)
        assert gone.isdisjoint(out.columns) and {"doc_id"} <= set(out.columns), name
    words = substrings.dedup_substrings(df.select(F.col("ids").alias("doc_id"), "text"))
    assert words.count() == 2  # ids of any type that has an order
