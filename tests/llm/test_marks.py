"""License scans, periodic runs and fill-in-the-middle against plain versions and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.test_llm import ODD, SCHEMA
from weftline.llm import infill, licenses, runs

CLASH = "doc_id long, text string, output string, form string, runs long, places string, n_words string, collapsed long, restored long, _text string"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "o", "f", 1, "p", "n", 2, 3, "t") for i, t in enumerate(texts)], CLASH)


def plain_runs(words, exponent=4, least=6):
    """Every period by itself: maximal stretches of words that equal the words one period on; the smallest period of equal ends."""
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_word_runs_equal_the_plain_search(exponent):
    rng = random.Random(exponent)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))]
            k, p = rng.randint(0, len(w)), rng.randint(1, 4)
            docs.append(w[:k] + (w[k : k + p] * 12)[: len(w)] + w[k:])
        words, doc = np.array([x for w in docs for x in w], np.int64), np.array([i for i, w in enumerate(docs) for _ in w], np.int64)
        ours, at = list(zip(*(x.tolist() for x in runs.word_runs(words, doc, exponent)))), 0
        want = []
        for w in docs:
            want += [(at + s, at + s + k, q) for s, k, q in plain_runs(w, exponent)]
            at += len(w)
        assert ours == want


def test_a_long_run_and_a_staircase():
    one = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in runs.word_runs(one, one)] == [[0], [200_000], [1]]
    values = np.concatenate([[-1], np.arange(5_000), [0], np.arange(5_000)[::-1], np.zeros(50, np.int64)])
    seen, want = [], []
    for i, v in enumerate(values.tolist()):
        while seen and values[seen[-1]] >= v:
            seen.pop()
        want.append(seen[-1] if seen else 0)
        seen.append(i)
    assert runs.smaller_before(values).tolist() == want


def test_runs_query_equals_the_plain_search(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = runs.op12_periodic_runs(spark, SMALL).collect()
    assert len(rows) == len(docs)
    some = 0
    for r in rows:
        words = (docs[r["doc_id"]] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # the plain search is quadratic
        found = plain_runs(words)
        some += len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, found)).hexdigest()
    assert some > 5


def test_runs_on_odd_rows(spark):
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é é é é é é é", "ab a b ab a b ab a b ab a b", "w " * 60_000]
    got = {r["doc_id"]: r for r in runs.find_runs(clashing(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        found = [(0, 60_000, 1)] if len(words) > 1000 else plain_runs(words)
        assert [tuple(x) for x in got[i]["runs"]] == found and got[i]["n_words"] == len(words)
        assert got[i]["collapsed"].encode() == plain_collapse(words, found) and got[i]["output"] == "o"
    assert sorted(len(r["runs"]) for r in runs.find_runs(spark.createDataFrame(ODD, SCHEMA).repartition(3)).collect()) == [0] * len(ODD)
    assert runs.find_runs(clashing(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(clashing(spark, []), min_exponent=1)


def plain_places(text):
    """Every template at every start, word by word."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    out = []
    for i, t in enumerate(licenses.TEMPLATES):
        w = [x.encode() for x in t.words]
        for s in range(-len(w), len(words)):
            same = [p for p in range(len(w)) if 0 <= s + p < len(words) and words[s + p] == w[p]]
            if len(same) >= t.need and set(t.key_places) <= set(same):
                out.append((s, i, len(same)))
    return len(words), [(licenses.TEMPLATES[i].label, s, k, len(licenses.TEMPLATES[i].words)) for s, i, k in sorted(out)]


def test_license_places_equal_the_plain_search(spark):
    rng = random.Random(5)
    pool = [w for t in licenses.TEMPLATES for w in t.words]
    texts = [None, "", "...", "MIT License", "mit\nlicense mit-license; MIT LICENSE", "CC BY-NC 4.0, cc by sa", "gnu general\tpublic license", "Apache LicenseX", "éapache license", "license apache"]
    texts += ["General Public License, version 3", "x " * 70_000 + "Eclipse Public License"]
    for t in licenses.TEMPLATES:
        w = t.words
        for _ in range(4):
            own = list(w)
            own[rng.randrange(len(own))] = "other"
            texts += [f"# {'-'.join(w).upper()} #", " ".join(own), " ".join(w[1:]), " ".join([*w[: len(w) // 2], "more", *w[len(w) // 2 :]])]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = clashing(spark, texts).repartition(3)
    index = licenses.build_index(licenses.document_frequencies(df))
    for r in licenses.scan(df, index).collect():
        n, found = plain_places(texts[r["doc_id"]])
        assert r["n_words"] == n and [tuple(p) for p in r["places"]] == found and r["output"] == "o"
    assert licenses.scan(clashing(spark, []), index).count() == 0
    assert licenses.document_frequencies(clashing(spark, [])) == {}
    assert licenses.scan(spark.createDataFrame(ODD, SCHEMA), index).filter("size(places) > 0").count() == 0


def test_license_words_are_counted_once_a_document(spark):
    df = spark.createDataFrame([(1, "mit MIT license"), (2, "license"), (3, None)], "doc_id long, text string").repartition(2)
    found = licenses.document_frequencies(df)
    assert found == {"mit": 1, "license": 2}
    index = licenses.build_index(found)
    mit = licenses.TEMPLATES.index(next(t for t in licenses.TEMPLATES if t.label == "mit"))
    assert index.lookups[mit] == (0, 1)  # the rarer word is looked up first


def test_infill_pieces_and_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a", " a b\n", "holds <P> itself", "<M>", "a < b <S", "é \U0001f600 ü", "P> <", "word " * 50_000]
    texts += ["".join(rng.choice("ab <>PSM\n\té") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = clashing(spark, texts).repartition(3)
    made = infill.transform(df, fim_rate=90, spm_rate=50)
    forms = set()
    for r in infill.restore(made).collect():
        text = (texts[r["doc_id"]] or "").encode()
        assert r["restored"].encode() == text and r["restored_sha256"] == hashlib.sha256(text).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
        buffers = [text, b"<P><S><M>"]
        assert b"".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r["pieces"]) == r["output"].encode()
        assert r["n_units"] == len(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        if r["form"] == "plain":
            assert r["output"].encode() == text and r["prefix_chars"] is None and r["middle_chars"] is None
        else:
            whole, a, m = text.decode(), r["prefix_chars"], r["middle_chars"]
            prefix, middle, suffix = whole[:a], whole[a : a + m], whole[a + m :]
            assert r["output"] == (f"<P>{prefix}<S>{suffix}<M>{middle}" if r["form"] == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}
    assert infill.restore(infill.transform(clashing(spark, []))).count() == 0
    odd = infill.restore(infill.transform(spark.createDataFrame(ODD, SCHEMA)))
    assert odd.filter(F.col("restored") == F.coalesce("text", F.lit(""))).count() == len(ODD)


def test_piece_tables_and_sentinels():
    held = infill.PieceTable(b"abcdef", b"!").cut([2, 2, 6])
    assert held.pieces == [(0, 0, 2), (0, 2, 0), (0, 2, 4), (0, 6, 0)] and held.text() == b"abcdef"
    order = (3, 1, 0, 2)
    assert held.arrange(order).text() == b"abcdef" and held.arrange(infill.inverse(order)).pieces[0] == (0, 0, 2)
    assert held.cut([1]).pieces[:2] == [(0, 0, 1), (0, 1, 1)]
    for bad in (("<P>", "<P>", "<M>"), ("<<", "b", "c"), ("ab", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.marks_of(bad)


def plain_coverage(item, text, least=5):
    """Greedy string tiling word by word: the longest run that both still have free is marked, until none of `least` words is left."""
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    places = {}
    for j, w in enumerate(text):
        places.setdefault(w, []).append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in places.get(item[i], ()):
                if i and j and free_i[i - 1] and free_t[j - 1] and item[i - 1] == text[j - 1]:
                    continue  # not the first word of its run
                k = 0
                while i + k < len(item) and j + k < len(text) and free_i[i + k] and free_t[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < min(least, len(item)) or not k:
            return covered / max(1, len(item))
        free_i[i : i + k], free_t[j : j + k] = [False] * k, [False] * k
        covered += k


def test_decontamination_finds_nothing_else(spark):
    from weftline.llm import decontaminate

    tok = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    read = lambda name: {r[0]: tok(r[1]) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect()}
    docs, items = read("documents"), read("benchmark")
    seeds = {}
    for i, w in items.items():
        for at in range(max(1, len(w) - 4)):
            seeds.setdefault(tuple(w[at : at + 5]), set()).add(i)
    near = {(d, i) for d, w in docs.items() for at in range(max(1, len(w) - 4)) for i in seeds.get(tuple(w[at : at + 5]), ())}
    want = {(d, i) for d, i in near if plain_coverage(items[i], docs[d]) >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op6_decontamination(spark, SMALL).collect()}
    assert got == want and want


def test_clashing_columns_and_empty_pages(spark):
    from weftline.llm import decontaminate, html, simhash, topk

    names = "component_id string, fingerprint string, item_id string, coverage string, n_tiles string, shard long, _in string, id string"
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i, text, *["c"] * 5, 7, "b", "d") for i in range(3)], f"doc_id long, text string, {names}").repartition(2)
    assert [r["component_id"] for r in simhash.near_duplicates(df).collect()] == [0, 0, 0]
    bench = spark.createDataFrame([(1, text, 9)], "item_id long, text string, doc_id long")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()) == [(0, 1), (1, 1), (2, 1)]
    assert decontaminate.clean(df, bench).count() == 0 and decontaminate.clean(df, bench).columns == df.columns
    v = spark.createDataFrame([(i, [1.0 * i], i, "r", 3) for i in range(4)], "vec_id long, v array<double>, score long, rank string, query_id int")
    got = topk.exact_top_k(topk.quantised(v, "vec_id", "v"), topk.quantised(v.filter("vec_id = 1"), "vec_id", "v"), 2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 3, 3 * 65536), (1, 2, 2, 2 * 65536)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lm_scores_a_very_long_text(spark):
    from weftline.llm import lm

    rows = [(i, f"the cat sat on mat {i}") for i in range(20)] + [(99, "the cat " * 150_000), (100, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model, vocab = lm.fit(df)
    got = {r["doc_id"]: r for r in lm.score(df, model, vocab).collect()}
    assert got[99]["n_tokens"] == 300_001 and got[100]["n_tokens"] == 2
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
