"""Cases worked by hand from the described behaviour, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.scalars import cleaned_words, days_since, parsed_time, permuted
from weftline.operators import builders, graph, literature, metrics, passing, sampling, summaries, temporal, text
from weftline.sources import readers, sinks

RING = [(i, (i + 1) % 6) for i in range(6)]


def column(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(expr(F.col("t"))).collect()]


def test_what_is_removed_leaves_a_blank(spark):
    got = column(spark, cleaned_words, "naïve", "www.a.b stays", "a#tag #b word42word", "You're off to the races", None)
    assert got == ["na", "stays", "word word", "races", ""]


def test_dates(spark):
    got = column(spark, lambda t: F.unix_seconds(parsed_time(t)), "Wed Oct 05 20:19:24 +0000 2011", "Wed Oct 05 20:19:24 2011", "2011-10-05 20:19:24", "yesterday", None)
    assert got == [1317845964] * 3 + [None, None]
    assert column(spark, lambda t: days_since(parsed_time(t), "2015-01-01"), "2014-12-31 12:00:00", "2013-01-01 00:00:00", "2016-01-01 00:00:00", "bad") == [0, 730, 0, 0]


def test_ages_keep_parts_of_a_second(spark):
    ms = [1705708800000 - 5 * 86_400_000 + x for x in (-1, 0, 1, 500, 1_000)]  # five days before the reference
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ms)], "i int, ms long").orderBy("i")
    assert [r[0] for r in rows.select(days_since(F.timestamp_millis("ms"), "2024-01-20")).collect()] == [5, 5, 4, 4, 4]


def test_pronouns_count_at_word_bounds(spark):
    r = text.style(spark.createDataFrame([("I like me, you and HERS. éme theirs",)], "text string")).first()
    assert r["n_words"] == 8 and r["first_person"] == pytest.approx(2 / 8) and r["third_person"] == pytest.approx(1 / 8)


def test_word_and_char_grams(spark):
    assert column(spark, lambda t: text.word_grams(text.word_tokens(t)), "Él a dió_2 x pie", None) == [["el", "dio_2", "pie", "el dio_2", "dio_2 pie"], []]
    assert column(spark, lambda t: text.char_grams(text.padded_words(t)), "ab c") == [[" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "]]


def test_negatives_on_a_dense_graph(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    pairs = [(u, v) for u in range(6) for v in range(u + 1, 6) if (u, v) not in ((0, 3), (2, 5))]
    got = temporal.sample_negatives(nodes, spark.createDataFrame(pairs, "u long, v long"), 10, 1).collect()
    assert len(got) == 10 and {(r["u"], r["v"]) for r in got} <= {(0, 3), (2, 5)}
    full = spark.createDataFrame([(u, v) for u in range(6) for v in range(u + 1, 6)], "u long, v long")
    assert temporal.sample_negatives(nodes, full, 3, 1).count() == 0
    assert temporal.sample_negatives(nodes.limit(0), full, 3, 1).count() == 0


def test_pagerank_equals_power_iteration(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 0), (3, 4)]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), tolerance=1e-13).collect()}
    rank = [0.2] * 5
    for _ in range(200):
        loose = sum(rank[i] for i in range(5) if not any(s == i for s, _ in edges))
        rank = [0.03 + 0.85 * (sum(rank[s] / sum(1 for a, _ in edges if a == s) for s, d in edges if d == i) + loose / 5) for i in range(5)]
    assert [got[i] for i in range(5)] == pytest.approx(rank, abs=1e-7)
    assert graph.pagerank(spark.createDataFrame(edges, "src long, dst long")).first()["residual"] < 5e-6


def test_walks_follow_edges(spark):
    edges = temporal.to_undirected(spark.createDataFrame([*RING, (0, 3)], "src long, dst long"))
    near = {(r["src"], r["dst"]) for r in edges.collect()}
    for p, q in ((1, 1), (1e-9, 1.0)):
        walks = {}
        for r in sampling.random_walks(edges, 3, 6, p, q, seed=4).collect():
            walks.setdefault((r["walk"], r["start"]), {})[r["step"]] = r["node"]
        assert len(walks) == 18 and all(len(w) == 6 and w[0] == k[1] and all((w[i], w[i + 1]) in near for i in range(5)) for k, w in walks.items())
        if p < 1:  # going back weighs nearly everything
            assert all(w[i] == w[i + 2] for w in walks.values() for i in range(4))
    dead = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert [r["step"] for r in sampling.random_walks(dead, 1, 5).orderBy("step").collect()] == [0, 1]


def test_biased_walks_have_the_weights(spark, monkeypatch):
    """From 1 to hub 0 (neighbours 1, 2, 3, 4; 2 is beside 1): shares 1/p, 1 and twice 1/q of their sum."""
    edges = temporal.to_undirected(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4), (1, 2)], "src long, dst long"))
    for most in (252, 0):  # rejected draws, or the race
        monkeypatch.setattr(sampling, "MOST_TRIES", most)
        walks = {}
        for r in sampling.random_walks(edges, 3_000, 3, 0.5, 4.0, seed=3).filter("start = 1").collect():
            walks.setdefault(r["walk"], {})[r["step"]] = r["node"]
        there = [w[2] for w in walks.values() if w[1] == 0]
        want = {1: 2.0 / 3.5, 2: 1 / 3.5, 3: 0.25 / 3.5, 4: 0.25 / 3.5}
        assert len(there) > 1_200 and all(abs(there.count(k) / len(there) - v) < 0.05 for k, v in want.items())


def test_a_hub_of_many_neighbours(spark):
    edges = temporal.to_undirected(spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    r = sampling.random_walks(edges, 1, 4, 1.0, 0.5, seed=1).groupBy("step").agg(F.count("*").alias("n"), F.countDistinct("node").alias("k")).orderBy("step").collect()
    assert [x["n"] for x in r] == [100_001] * 4 and r[1]["k"] == 2 and r[2]["k"] > 50_000


def test_permutations(spark):
    for n in (1, 2, 7, 1_000):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit("w"), seed=5).alias("x"), permuted(F.col("id"), F.lit(n), F.lit("z"), seed=5).alias("y")).collect()
        assert sorted(r["x"] for r in got) == sorted(r["y"] for r in got) == list(range(n))
    assert [r["x"] for r in got] != [r["y"] for r in got] and sum(r["x"] == i for i, r in enumerate(got)) < 20


def test_layers_on_a_ring(spark):
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "node long, x array<double>")
    ring = temporal.to_undirected(spark.createDataFrame(RING, "src long, dst long"))
    flat = nodes.select("node", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    head = {"send": [[1.0, 0.0], [0.0, 1.0]], "from": [0.3, 0.1], "to": [0.2, 0.4]}
    assert {tuple(round(v, 9) for v in r["x"]) for r in passing.attention(flat, ring, [head]).collect()} == {(1.0, 2.0)}  # shares sum to one
    shifted = nodes.select(((F.col("node") + 2) % 6).alias("node"), "x")
    a = {r["node"]: r["x"] for r in passing.row_normalised(nodes, ring).collect()}
    b = {r["node"]: r["x"] for r in passing.row_normalised(shifted, ring).collect()}
    assert all(b[(i + 2) % 6] == pytest.approx(a[i]) for i in range(6))
    alone = spark.createDataFrame([(9, [3.0, 4.0])], "node long, x array<double>")
    none = spark.createDataFrame([], "src long, dst long")
    assert passing.sage(alone, none, [[1.0], [0.0], [5.0], [5.0]]).first()["x"] == [3.0]
    assert passing.unit_rows(alone).first()["x"] == [0.6, 0.8] and passing.row_normalised(alone, none).first()["x"] == [3.0, 4.0]


def test_similarity_graphs_leave_out_the_node_itself(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vec array<double>")
    assert sorted(map(tuple, builders.threshold_graph(v, 0.8).collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, builders.knn_graph(v, 1, undirected=False).collect())) == [(1, 2), (1, 3), (1, 4), (2, 1)]
    with pytest.raises(ValueError):
        builders.build("other")


def test_veracity(spark):
    rows = [(0, 0), (0, 1), (1, 0), (1, 1), (0, None), (1, None), (None, 1), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m int, t int").orderBy("i").select(summaries.veracity(F.col("m"), F.col("t"))).collect()]
    assert got == ["unverified", "true", "false", None, "unverified", "false", None, None]


def test_reindex_by_first_appearance(spark):
    e = spark.createDataFrame([("c", "a", 2), ("b", "c", 1), ("a", "a", 3)], "src string, dst string, ts long")
    edges, names = summaries.reindexed(e, ["ts"])
    assert {r["label"]: r["idx"] for r in names.collect()} == {"b": 0, "c": 1, "a": 2}
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 1), (1, 2, 2), (2, 2, 3)]


def test_paired_and_multiclass(spark):
    zero = spark.createDataFrame([(0.0,), (0.0,)], "d double")
    assert metrics.paired(zero).first()["p"] == 1.0
    many = metrics.paired(spark.createDataFrame([((-1) ** i * (i + 1.0),) for i in range(40)], "d double")).first()
    assert many["n"] == 40 and 0.5 < many["p"] <= 1
    scores = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.1), ("b", "a", 0.2), ("b", "b", 0.8)], "label string, class string, score double")
    assert metrics.one_vs_rest_auc(scores).first()["auc"] == 1.0


def test_taxonomy_with_a_cycle_ends(spark):
    t = spark.createDataFrame([("root", None, 0, []), ("a", "root", 1, ["x"]), ("b", "a", 0, []), ("loop", "loop2", 0, []), ("loop2", "loop", 0, [])], "label string, parent string, place int, refs array<string>")
    assert {r["label"]: r["path"] for r in literature.taxonomy_paths(t).collect()} == {"root": "root", "a": "root > a", "b": "root > a > b"}
    assert [(r["line"], r["leaf"], r["refs"]) for r in literature.described(t).orderBy("order").collect()] == [("root", False, 0), ("    a", False, 1), ("        b", True, 0)]


def test_readers_on_awkward_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a b 3\n a  c\t5 \nonly two\n1 2 3 4\nx y z\n")
    assert sorted(map(tuple, readers.message_list(spark, str(tmp_path / "m.txt")).collect())) == [("a", "b", 3), ("a", "c", 5)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "rumor_1_u0.json").write_bytes('[{"mid": "m1", "uid": "u1", "parent": "", "date": "2020-01-01 00:00:00", "text": "转发"}, {"mid": "m1", "uid": "u2", "parent": "m1", "date": "bad"}, {"uid": "u3", "parent": "m1", "date": "2020-01-01 00:01:00"}, {"uid": "u0", "parent": "gone", "date": "2020-01-01 00:01:00"}]'.encode("gb18030"))
    (tmp_path / "j" / "bad.json").write_bytes(b"\xff\xfe{")
    assert {r["text"] is None for r in readers.lenient_json(spark, str(tmp_path / "j")).collect()} == {True, False}
    assert sorted((r["src"], r["dst"]) for r in readers.repost_edges(spark, str(tmp_path / "j")).collect()) == [("u0", "u1"), ("u2", "u3")]
    row = ["1", "true", 'an "unbalanced quote', "s", "p", "", "", "none", "", "1", "2", "3", "4", "c"]
    (tmp_path / "train.tsv").write_text("\t".join(row) + "\nshort\trow\n" + "\t".join(["2", "odd", *row[2:]]) + "\n")
    got = readers.statements(spark, str(tmp_path / "train.tsv")).collect()
    assert [(r["id"], r["statement"], r["split"], r["credit"]) for r in got] == [("1", 'an "unbalanced quote', "train", [0, 1, 2, 3, 4])]
    with pytest.raises(ValueError):
        readers.load("other", spark)


def test_caches_know_their_rules(spark, tmp_path):
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    for rules, n, want in ((1, 3, 3), (1, 9, 3), (2, 5, 5)):
        assert sinks.cached(spark, str(tmp_path), "t", {"rules": rules}, lambda n=n: build(n), "id").count() == want
    assert made == [3, 5]
    x = spark.createDataFrame([("a,b", 'say "x"', None)], "a string, b string, c int")
    assert [tuple(r) for r in sinks.table_csv(x, str(tmp_path / "csv")).collect()] == [("a,b", 'say "x"', None)]


def test_augmented_snapshots_keep_quotas(spark):
    rnd = random.Random(1)
    pairs = {(0, *sorted(rnd.sample(range(60), 2))) for _ in range(400)}
    out = sampling.augment(spark.createDataFrame(sorted(pairs), "w int, u long, v long"), seed=2).collect()
    new = [r for r in out if tuple(r) not in pairs]
    assert len(new) <= round(0.05 * len(pairs)) and all(r["u"] < r["v"] < 63 for r in out)
    nodes = {x for r in out for x in (r["u"], r["v"])} & set(range(60))
    assert len(nodes) <= 60 - round(0.02 * 60)
    assert math.isclose(len(out), len(pairs), rel_tol=0.1)


def test_terms_are_linear_in_the_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"w{i % 997}" for i in range(n)))], "item_id long, text string")
        t = time.time()
        assert text.tf_idf(df, F.lit(True), min_df=1).count() > 900
        return time.time() - t

    seconds(1_000)
    assert seconds(200_000) < 20  # once for each bigram would be 4 * 10^10 tokens


def test_row_softmax_of_a_long_row(spark):
    r = spark.range(1).select(passing.row_softmax(F.array_repeat(F.lit(3.0), 50_000)).alias("x")).select(F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("s"), F.element_at("x", 7).alias("v")).first()
    assert r["s"] == pytest.approx(1) and r["v"] == pytest.approx(1 / 50_000)


def breadth_first(edges):
    near, out = {}, {}
    for item, parent, child in edges:
        near.setdefault((item, parent), set()).add(child)
    for item in {e[0] for e in edges}:
        level, d = {0}, 0
        while level:
            out |= {(item, n): d for n in level}
            level, d = {c for n in level for c in near.get((item, n), ()) if (item, c) not in out}, d + 1
    return out


def test_depths_with_several_parents_cycles_and_orphans(spark):
    rng = random.Random(8)
    for extra in (0.0, 0.1, 0.6):
        edges = []
        for item in range(25):
            n = rng.randint(1, 30)
            for child in range(1, n):
                edges += [(item, rng.randrange(n if rng.random() < 0.2 else child), child) for _ in range(1 + (rng.random() < extra))]
            edges.append((item, 0, 0))
        edges += edges[:5]
        got = {(r["item_id"], r["node"]): r["depth"] for r in graph.cascade_depths(spark.createDataFrame(edges, "item_id int, parent int, child int")).collect()}
        assert got == breadth_first(edges)


def test_a_chain_of_ten_thousand(spark):
    chain = spark.range(10_000).select(F.lit(1).alias("item_id"), F.col("id").cast("int").alias("parent"), (F.col("id") + 1).cast("int").alias("child"))
    r = graph.cascade_depths(chain).agg(F.max("depth").alias("d"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("node")).alias("same")).first()
    assert (r["d"], r["n"], r["same"]) == (10_000, 10_001, 10_001)


def test_deep_taxonomy(spark):
    t = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i % 3, []) for i in range(40)] + [("x", "nowhere", 0, [])], "label string, parent string, place int, refs array<string>")
    got = {r["label"]: (r["depth"], r["path"]) for r in literature.taxonomy_paths(t).collect()}
    assert got == {f"n{i}": (i, " > ".join(f"n{j}" for j in range(i + 1))) for i in range(40)}
    assert literature.taxonomy_paths(t.limit(0)).count() == 0
