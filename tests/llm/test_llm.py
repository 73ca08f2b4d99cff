"""The llm operators against brute force and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import canonical, connect
from weftline.llm import bpe, decontaminate, html, langid, lines, lm, queries, sharding, simhash, substrings, topk

ODD = [(1, "", "x"), (2, None, "x"), (None, "some words stand here for once", None), (4, "a b c", "y"), (4, "a b c", "y"), (5, "é" * 3000, None), (6, " \n\t", "z"), (7, "line one\nline 2\n\nline one", "z")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def test_sql_queries(spark):
    con = connect(SMALL)
    for name, sql in queries.oracle_sql().items():
        ours, theirs = queries.queries()[name](spark, SMALL).toPandas(), con.execute(sql).df()
        assert canonical(ours[sorted(theirs.columns)]) == canonical(theirs), name


def test_bpe_equals_the_library_and_round_trips(spark, docs, odd):
    import tiktoken

    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = [*docs.text, *("".join(rng.choice("ab'strevldm  \n\té1٣!?.中\U0001f600\u0085") for _ in range(40)) for _ in range(300)), "", None, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in bpe.decode(bpe.encode(df, path, offsets=True), path).collect():
        text = texts[r["doc_id"]] or ""
        assert [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)] == theirs.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        ends = [int.from_bytes(r["piece_ends"][i : i + 4], "little") for i in range(0, len(r["piece_ends"]), 4)]
        assert not text or ends[-1] == len(text.encode())
    every = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    for at in range(0, len(every), 8000):  # every codepoint beside letters and digits
        text = "".join(f"a{c}a1{c}1 " for c in every[at : at + 8000])
        buf, cuts = bpe.boundaries([text])
        ids = [x for a, b in zip(cuts[:-2].tolist(), cuts[1:-1].tolist()) for x in bpe.merge(buf[a:b], theirs._mergeable_ranks)]
        assert ids == theirs.encode_ordinary(text)
    for n in (129, 700):
        piece = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert bpe.merge(piece.encode(), theirs._mergeable_ranks) == theirs.encode_ordinary(piece)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    assert bytes(bpe.decode(bpe.encode(spark.createDataFrame([(long, "x")], "text string, ids string"), path), path).first()["decoded"]) == long.encode()
    assert bpe.encode(odd.filter("false"), path).count() == 0 and bpe.encode(odd, path).count() == len(ODD)


def test_best_fit_decreasing():
    tree, plain, rng = sharding.RemainingTree(), {}, random.Random(2)
    for _ in range(3000):
        b, new = rng.randrange(60), rng.randrange(40)
        tree.move(b, plain.get(b), new)
        plain[b] = new
        size = rng.randrange(45)
        assert tree.tightest(size) == min(((r, x) for x, r in plain.items() if r >= size), default=(0, None))[1]
        assert tree.emptiest() == min((-r, x) for x, r in plain.items())[1]
    assert tree.root.height <= 9
    got = sharding.best_fit_decreasing([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 2)], 8)
    assert sorted(got.loads) == [8, 8] and got.bin_of["a"] == got.bin_of["c"]


def test_sharding(spark, docs, odd):
    got = sharding.op3_sharding(spark, SMALL).toPandas()
    assert len(got) == len(docs) and set(got["law"]) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= got["size"].max()
    by = docs.merge(got, on="doc_id")
    assert (by.groupby("text").shard.nunique() == 1).all()
    assert (by["size"] == by.text.str.encode("utf-8").str.len() + 1).all() and (by.text_crc32 == [zlib.crc32(t.encode()) for t in by.text]).all()
    few = sharding.shard_by_size(odd, F.octet_length(F.coalesce("text", F.lit(""))) + 1, F.col("text"), [F.col("doc_id"), F.col("text")], capacity=4000).collect()
    assert len(few) == len(ODD) and {r["shard"] for r in few} <= {0, 1, 2}
    many = spark.range(30_000).select(F.col("id").alias("shard"), (F.col("id") % 9 + 2).alias("n"))
    loads = sharding.shard_by_size(many, F.col("n"), F.col("shard"), [F.col("shard")], capacity=20).groupBy("shard").agg(F.sum("n").alias("n")).toPandas().n
    assert loads.max() <= 20 and len(loads) <= 1.01 * 30_000 * 6 / 20
    assert sharding.shard_by_size(odd.filter("false"), F.lit(1), F.col("text"), [F.col("doc_id")], n_shards=2).count() == 0


def test_even_shards_at_every_level(spark, monkeypatch):
    rng = random.Random(6)
    sizes = {f"g{i:04d}": int(rng.paretovariate(1.1) * 20) for i in range(3_000)}
    sizes["g0000"] = sum(sizes.values()) // 6
    df = spark.createDataFrame([(g, s - s // 2) for g, s in sizes.items()] + [(g, s // 2) for g, s in sizes.items()], "g string, n long").repartition(5)
    spread = {}
    for items in (10_000, 300):  # on the driver at once, or in levels of ranges
        monkeypatch.setattr(sharding, "DRIVER_ITEMS", items)
        monkeypatch.setattr(sharding, "RANGE_ITEMS", 100)
        monkeypatch.setattr(sharding, "RANGE_BINS", 20)
        got = sharding.shard_by_size(df, F.col("n"), F.col("g"), [F.col("g"), F.col("n")], n_shards=5).collect()
        shard, load = {}, [0] * 5
        for r in got:
            assert shard.setdefault(r["g"], r["shard"]) == r["shard"]
            load[r["shard"]] += r["n"]
        assert len(got) == 6_000 and sum(load) == sum(sizes.values())
        spread[items] = max(load) / (sum(load) / 5)
    assert spread[10_000] < 1.001 and spread[300] < 1.02


def test_top_k_ties_nulls_and_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [-1.0, 2.0]), (None, [1.0, 1.0]), (50, [0.5, 0.5])]
    c = topk.quantised(spark.createDataFrame(rows, "vec_id long, v array<float>"), "vec_id", "v")
    got = [tuple(r) for r in topk.exact_top_k(c, c.filter("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (50, 1, 0, 32768), (50, 2, 1, 32768)]
    assert topk.exact_top_k(c.filter("false"), c, 2).count() == 0 and topk.exact_top_k(c, c.filter("false"), 2).count() == 0
    assert topk.exact_top_k(c, c.filter("vec_id = 0"), 9).count() == 4
    wide = topk.quantised(spark.createDataFrame([(0, [1e8]), (1, [1.0]), (2, [-1e8]), (3, [0.5])], "vec_id long, v array<double>"), "vec_id", "v")
    assert [tuple(r)[2:] for r in topk.exact_top_k(wide, wide.filter("vec_id = 1"), 3).orderBy("rank").collect()] == [(0, 256 * 25_600_000_000), (3, 256 * 128), (2, -256 * 25_600_000_000)]


@pytest.mark.parametrize("scale", [256, 1 << 20, 1 << 28])  # scores in float32, float64 and int64
def test_top_k_in_many_blocks(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(scale)
    v = rng.integers(-3, 4, (200, 5)) / 4
    c = topk.quantised(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>"), "vec_id", "v", scale)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(c, c.filter("vec_id % 3 = 0"), 4).collect()}
    q = np.floor(v * scale).astype(np.int64)
    want = {}
    for i in range(0, 200, 3):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(200) if j != i)[:4]
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
    assert got == want


def test_language_accuracy(spark, docs, odd):
    got = langid.op5_language_id(spark, SMALL).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    model = langid.fit(odd)
    told = langid.identify(odd, model).collect()
    assert len(told) == len(ODD) and all(r["lang_pred"] == "und" for r in told if not any(map(str.isalpha, r["text"] or "")))
    assert langid.identify(odd.filter("false"), model).count() == 0 and {r["lang_pred"] for r in langid.identify(odd, []).collect()} == {"und"}


def test_line_dedup_rows(spark, odd):
    rows = [(i, f"Page {i} of 9\nown text {'abcdefghijklmnopqrstuvwxyz'[i]} here") for i in range(25)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"].startswith("Page") and all(got[i]["text"] == rows[i][1].split("\n")[1] for i in range(1, 25))
    words = [(i, f"hello and also {'abcdefghijklmnopqrstuvwxyz'[i]}x world common text\nits own {i % 3}") for i in range(26)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(words, "doc_id long, text string").repartition(4)).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_dropped"] == 2 for i in range(1, 26))  # one differing word is a field
    few = lines.dedup_lines(odd, min_docs=2).collect()
    assert len(few) == len(ODD) and lines.dedup_lines(odd.filter("false")).count() == 0


def test_tiling_catches_reordered_passages(spark, odd):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "tiny item"), (3, None), (3, "")], "item_id long, text string")
    text = " ".join(["x", *words[20:], "y", *words[:20], "z"]).upper()
    rows = [(1, text), (2, " ".join(words[:25])), (3, "a tiny, ITEM!"), (4, None), (5, "clean words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in decontaminate.matches(df, bench).collect()) == [(1, 1, 2, 1.0), (3, 2, 1, 1.0)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [2, 4, 5]
    assert decontaminate.clean(odd, bench.filter("false")).count() == len(ODD) and decontaminate.matches(odd.filter("false"), bench).count() == 0


def test_decontamination_equals_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, b in zip(bench.item_id, bench.text) if " ".join(tok(b)) in " ".join(tok(t))}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op6_decontamination(spark, SMALL).collect()}
    assert want <= got


def test_simhash_equals_brute_force(spark, docs, odd):
    got = simhash.op7_simhash(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    fps = [simhash.fingerprint(t.encode()) for t in docs.text]
    lead = list(range(len(fps)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    assert list(got.component_id) == [docs.doc_id[find(i)] for i in range(len(fps))]
    assert list(got.fingerprint) == [f"{f:016x}" for f in fps]
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == len(ODD) and {r["fp"] for r in near if r["doc_id"] in (1, 2, 6)} == {0}
    assert simhash.near_duplicates(odd.filter("false")).count() == 0
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(odd).collect()) == ["1", "4", "5", "7", "None"]


def test_fingerprint_by_hand():
    import xxhash

    words = b"the quick brown fox jumps over".split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint(b"The QUICK brown\tfox\n jumps over") == want and simhash.fingerprint(b" ") == 0


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p><article>x";</script></head><body><div class="cookie-notice">We use cookies</div><nav><a href=x>Home</a></nav>
    <article><h1>Head &amp; line</h1><p>One   two<b>three</b><br>four<p>five &lt;six&gt;<div class="ad">Buy!</div><p>seven</p><form><input>mail</form><section id="comments"><p>Nice!</p></section></article><aside>side</aside><footer>&copy;</footer></body></html>"""
    assert html.main_text(page) == "Head & line\nOne twothree\nfour\nfive <six>\nseven"
    assert html.main_text('<article><p class="ad">Buy<p>Body stays</article>') == "Body stays" and html.main_text("<ul><li class=ad>x<li>Body of a list item</ul>") == "Body of a list item"
    assert html.main_text('<div class="page no-sidebar"><article><p class="share-price">Short<p>lines</article></div><div class=sidebar>no</div>') == "lines"
    assert html.main_text('<main><h1>Head</h1><article class="comment">no</article><p>a' + " very" * 200_000 + "</main>").count("very") == 200_000
    plain = "<div><a href=a>Menu one</a> <a href=b>Menu two</a></div><div>" + "Body text of some length here. " * 5 + "</div><div>tail line</div><hr><div><a href=c>more</a></div>"
    assert html.main_text(plain).startswith("Body text") and "Menu" not in html.main_text(plain)
    assert html.main_text("") == "" and html.main_text("<p></p>") == "" and html.main_text("a < b") == "a < b"


def test_pages(spark):
    got = html.op8_html_text(spark, SMALL).toPandas()
    assert (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()
    assert html.extract(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first()["text"] == ""


def test_lm_base_and_gain(spark, docs, odd):
    got = lm.op9_lm_score(spark, SMALL).toPandas().set_index("doc_id")
    tok = lambda t: t.encode().lower().split()
    c = collections.Counter()
    for i, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 10:
            c.update(tok(t))
            c["end"] += 1
    n = sum(c.values())
    for i, t in zip(docs.doc_id, docs.text):
        ws = [*tok(t), "end"]
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws), rel=1e-9)
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()
    model, vocab = lm.fit(odd)
    assert lm.score(odd, model, vocab).count() == len(ODD) and lm.score(odd.filter("false"), model, vocab).count() == 0
    model, vocab = lm.fit(odd.filter("false"))
    assert all(r["base_score"] == pytest.approx(0) for r in lm.score(odd.filter("doc_id = 1"), model, vocab).collect())


def test_lm_probabilities_sum_to_one(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    model, vocab = lm.fit(df)
    n = len(model.words)
    assert n > 100 and np.abs(model.class_weights).max() > 0.1 and np.abs(model.group_weights).max() > 0.1
    w = np.arange(n + 2)  # every head word, the tail as a whole, the end
    for one, two in ((n + 2, n + 2), (0, n + 2), (3, 17), (n, 2)):
        log_p = model.log_probabilities(w, np.full(n + 2, one), np.full(n + 2, two))
        assert (10**log_p).sum() == pytest.approx(1, abs=1e-4)
    rare = vocab.filter(F.col("c") < lm.HEAD_COUNT).count()
    tail = vocab.filter(F.col("c") < lm.HEAD_COUNT).agg(F.sum("c")).first()[0]
    assert tail + lm.SMOOTH * (rare + 1) == pytest.approx(model.tail_total)  # known tail words and one unknown share the tail


def test_lm_scores_by_hand(spark):
    df = spark.createDataFrame([(i, f"a b{i % 4} c{i % 7} a a") for i in range(60)] + [(99, "z" * 100), (98, None)], "doc_id long, text string")
    model, vocab = lm.fit(df)
    got = {r["doc_id"]: r for r in lm.score(df, model, vocab).collect()}
    ids = {w: i for i, w in enumerate(model.words)}
    n = len(ids)
    w = np.array([*[ids[x] for x in b"a b1 c1 a a".split()], n + 1])
    one, two = lm.contexts(w, n + 1, n + 2)
    assert list(one) == [n + 2, *w[:5]] and list(two) == [n + 2, n + 2, *w[:4]]
    assert got[1]["score"] == pytest.approx(model.log_probabilities(w, one, two).sum(), rel=1e-6) and got[1]["n_known"] == 6
    assert got[99]["n_known"] == 2 and got[98]["n_tokens"] == 1


def brute_substrings(rows, k=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if t[p : p + k] in seen:
                gone[p : p + k] = b"\1" * k
            seen.add(t[p : p + k])
        out[i] = (sum(gone), sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3, 1000])
def test_substrings_equal_brute_force(spark, odd, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(200, ""), (201, "ab" * 300)]
    for i in range(100):
        a = rng.randrange(0, 300)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(50))) + base[a : rng.randrange(a, 400)] + "é" * rng.randrange(9) + (base[:150] if i % 3 == 0 else "")))
    want = brute_substrings([(i, t.encode()) for i, t in rows])
    for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        kept = bytes(r["kept"])
        assert (r["n_bytes"] - len(kept), len(r["removed"]), hashlib.sha256(kept).hexdigest()) == want[r["doc_id"]]
    assert substrings.dedup_substrings(odd).count() == len(ODD) and substrings.dedup_substrings(odd.filter("false")).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    got = out.toPandas()
    assert 0.5 * len(docs) < len(got) < len(docs) and got.round_trip.all() and got.doc_id.is_unique
    assert decontaminate.matches(out.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0


def test_near_copies_of_the_similarity_go(spark):
    rnd = random.Random(5)
    texts, group = [], []
    for g in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for c in range(rnd.randrange(1, 5)):
            copy = list(words)
            for at in rnd.sample(range(120), 0 if c == 0 else rnd.randrange(1, 3)):
                copy[at] = f"x{rnd.randrange(9999)}"
            texts.append(" ".join(copy))
            group.append(g)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert all(group[i] == group[j] for i, j in alike)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = {(r["a"], r["b"]) for r in simhash.similar_links(df, "doc_id", "text").collect()}
    assert links <= alike
    lead = list(range(len(texts)))
    for i, j in sorted(alike):
        lead = [min(lead[i], lead[j]) if x in (lead[i], lead[j]) else x for x in lead]
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    want = set(lead)
    assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_absorbing_forest_and_wide_fingerprints():
    rnd = np.random.default_rng(3)
    fp = rnd.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    fp[100:200] = fp[0] ^ (np.uint64(1) << rnd.integers(0, 63, (100, 2)).astype(np.uint64))
    forest = simhash.Forest(np.repeat([1, 2], 150), fp, absorb=-1)
    far = lambda a, b: int(np.bitwise_count(fp[a] ^ fp[b]).sum())
    got = {(int(a), int(b)) for q, n in forest.near(np.arange(300), 6) for a, b in zip(q, n)}
    assert got == {(a, b) for a in range(300) for b in range(300) if a // 150 == b // 150 and far(a, b) <= 6}
    assert len(simhash.Forest(np.repeat([1, 2], 150), fp, absorb=6).nodes) < len(forest.nodes)
    assert not simhash.wide_fingerprint(b" ").any() and (simhash.wide_fingerprint(b"A b c") == simhash.wide_fingerprint(b"a B\tc")).all()


def test_near_copies_inside_a_template_cluster_go(spark, monkeypatch):
    rnd = random.Random(11)
    template = [f"t{i}" for i in range(160)]
    texts = []
    for g in range(200):
        own = [*template, *(f"o{rnd.randrange(10**6)}" for _ in range(25))]
        copy = list(own)
        copy[rnd.randrange(165, 180)] = "other"
        texts += [" ".join(own), " ".join(copy)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(181)} for t in texts]
    similar = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    alike = {(j, i) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similar(i, j) >= 0.8}
    assert alike == {(2 * g + 1, 2 * g) for g in range(200)} and similar(0, 2) > 0.7
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for side in (simhash.SIDE, 16):  # one cell a shard, and shards dealt over many
        monkeypatch.setattr(simhash, "SIDE", side)
        links = {(r["a"], r["b"]) for r in simhash.similar_links(df, "doc_id", "text").collect()}
        assert links <= alike and len(links) >= 0.99 * len(alike)


def test_cells_of_a_large_shard_hold_every_pair_once():
    root = np.array([7] * 50 + [1, 1, 2, 3, 4] * 8 + [7] * 20)
    got = collections.Counter()
    for r, side, _ in simhash._dealt(np.arange(len(root)), root, 16):
        got.update((int(x), int(y)) for i, x in enumerate(r) for j, y in enumerate(r) if x < y and root[x] != root[y] and (side[i] == 2 or side[i] != side[j]))
    assert got == {(x, y): 1 for x in range(110) for y in range(x + 1, 110) if root[x] != root[y]}
