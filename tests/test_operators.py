"""Closed forms and hand-worked cases."""

from math import log

import pytest
from pyspark.sql import functions as F

from weftline.functions.scalars import cleaned_words, post_type
from weftline.operators import graph, metrics, series, temporal


def entropies(spark, pairs, alpha=0.6):
    snaps = spark.createDataFrame([(0, *sorted(p)) for p in pairs], "w int, u long, v long")
    return {r["node"]: r["h"] for r in temporal.local_entropy(snaps, alpha).collect()}


def test_star_cycle_and_complete_graphs(spark):
    star = entropies(spark, [(0, i) for i in range(1, 6)])
    assert star[0] == pytest.approx(log(5)) and star[1] == pytest.approx(0)
    assert set(map(lambda h: round(h, 9), entropies(spark, [(i, (i + 1) % 6) for i in range(6)]).values())) == {round(log(2), 9)}
    assert set(map(lambda h: round(h, 9), entropies(spark, [(i, j) for i in range(6) for j in range(i)]).values())) == {round(log(5), 9)}


def test_loop_counts_twice_in_degree(spark):
    snaps = spark.createDataFrame([(0, 1, 1), (0, 1, 2)], "w int, u long, v long")
    assert {r["node"]: r["deg"] for r in temporal.degrees(snaps).collect()} == {1: 3, 2: 1}


def test_empty_window_counts_as_a_step(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 5), (1, 2, 25)], "src long, dst long, ts long")
    got = sorted(temporal.weighted_series(temporal.global_entropy(temporal.snapshots(edges, 10))).collect())
    assert [r["w"] for r in got] == [0, 1, 2] and got[1]["h"] == 0
    assert got[2]["weighted_h"] == pytest.approx(got[0]["h"] * 2.718281828459045 ** -2.4)


def test_bursts(spark):
    rows = [("a", 5 * i, i, 5, 5 if i < 2 else None) for i in range(3)] + [("b", 0, 0, 1, None)]
    got = {r["account_id"]: r for r in series.bursts(spark.createDataFrame(rows, "account_id string, ts_ms long, post_id long, dt long, next_dt long")).collect()}
    assert (got["a"]["burstiness"], got["a"]["memory"], got["a"]["cv"]) == pytest.approx((-1, 0, 0), abs=1e-9)
    assert (got["b"]["burstiness"], got["b"]["cv"]) == (0, 0)


def test_log_bins_edges(spark):
    x = spark.createDataFrame([("a", v) for v in (0, 1, 1_000_000, 1_000_001)], "k string, dt long")
    got = {r["bin"]: r["n"] for r in series.log_bins(x, "k", 24, 1.0, 1e6).collect()}
    assert got == {0: 1, 1: 1, 24: 1}


def test_uniform_spectrum_is_flat(spark):
    got = series.spectrum(spark.createDataFrame([("a", b, 3) for b in range(16)], "k string, bin int, n long"), "k").first()
    assert list(got)[1:] == pytest.approx([4.0] * 6)


def test_post_types_and_cleaning(spark):
    rows = ["RT @a: @b hi", "@a hi", "see https://t.co/x ", "plain", ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(post_type(F.col("t"))).collect()] == [2, 1, 3, 0, 0]
    one = spark.createDataFrame([("You're BREAKING!! 500 http://t.co/a @b #c é",)], "t string")
    assert one.select(cleaned_words(one["t"], ["you", "re"])).first()[0] == "breaking"


def test_metrics(spark):
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert metrics.auc(ties).first()[0] == 0.5
    assert metrics.auc(ties.filter("label = 1")).first()[0] is None
    up = spark.createDataFrame([(0.1 * (i + 1),) for i in range(10)], "d double")
    assert metrics.paired(up).first()["p"] == pytest.approx(2 / 2**10)
    assert metrics.min_max(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"]).first()[0] == 0


def test_depths_and_ring(spark):
    e = spark.createDataFrame([("c", 0, 1), ("c", 1, 2), ("c", 2, 3), ("s", 0, 1), ("s", 0, 2)], "item_id string, parent int, child int")
    deep = {}
    for r in graph.cascade_depths(e).collect():
        deep[r["item_id"]] = max(deep.get(r["item_id"], 0), r["depth"])
    assert deep == {"c": 3, "s": 1}
    nodes = spark.createDataFrame([(i, [1.0]) for i in range(6)], "node long, x array<double>")
    ring = temporal.to_undirected(spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long"))
    assert {round(r["x"][0], 9) for r in graph.gcn(nodes, ring).collect()} == {1.0}
    assert {round(r["x"][0], 9) for r in graph.gcn(nodes, ring, "paper").collect()} == {1.5}


def test_attribute_groups_above_the_bound_become_rings(spark):
    import hashlib

    rows = [(i, "party", "big", 0) for i in range(500)] + [(i, "party", "wide", 0) for i in range(600, 621)] + [(i, "party", "few", 0) for i in range(700, 705)]
    got = {(r["src"], r["dst"]) for r in graph.attribute_pairs(spark.createDataFrame(rows, "item_id long, attr string, value string, x int").drop("x"), max_group=20).collect()}
    want = {(a, b) for a in range(700, 705) for b in range(700, 705) if a != b}
    for value, ids in (("big", range(500)), ("wide", range(600, 621))):
        for k in range(20):
            ring = sorted(ids, key=lambda i: (hashlib.md5(f"party|{value}|{k}|{i}|0".encode()).hexdigest()[:16], i))
            want |= {p for a, b in zip(ring, ring[1:] + ring[:1]) for p in ((a, b), (b, a))}
    assert got == want


def test_signed_ranks_are_exact():
    import itertools

    from weftline.operators.metrics import signed_rank_p

    ranks = [1, 2.5, 2.5, 4, 5, 6, 7, 8, 9, 10]  # a tie
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=10)]
    for up in (0, 8, 10.5, 27.5, 55):
        low = min(up, sum(ranks) - up)
        assert signed_rank_p(ranks, up) == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / 1024), abs=0)
    assert signed_rank_p(list(range(1, 11)), 8) == pytest.approx(0.048828125, abs=1e-12)
    assert signed_rank_p(list(range(1, 26)), 89) < 0.05 < signed_rank_p(list(range(1, 26)), 90)  # the printed 5 % point is 89
    assert signed_rank_p(list(range(1, 51)), 434) < 0.05 < signed_rank_p(list(range(1, 51)), 435)  # 434
    assert signed_rank_p(list(range(1, 51)), 0) == 2 / 2**50


def test_worse_methods_do_not_clear(spark):
    df = lambda sign: spark.createDataFrame([(sign * (0.05 + i / 1000),) for i in range(12)], "d double")
    up, down = metrics.paired(df(1)).first(), metrics.paired(df(-1), population=True).first()
    assert up["clears"] and up["significant"] and not down["clears"] and down["significant"]
    assert up["sd"] == pytest.approx(down["sd"] * (12 / 11) ** 0.5)


def test_accounts_outside_the_bins_stay(spark):
    rows = [(1, 500 * 86_400_000 * i, i) for i in range(6)] + [(2, 1000 * i * i, 10 + i) for i in range(6)]
    got = {r["account_id"]: r for r in series.temporal_blocks(spark.createDataFrame(rows, "account_id long, ts_ms long, post_id long")).collect()}
    assert got[1]["gap_H_1"] == 0 and got[1]["hour_H_1"] == pytest.approx(0) and got[2]["gap_H_1"] > 0


def test_messages_end_at_the_share_of_the_training_time(spark):
    edges = spark.createDataFrame([(9, 9, 0), *[(i, i + 1, 100 * (i + 1)) for i in range(10)]], "src long, dst long, ts long")
    got = temporal.link_samples(edges).filter("label = 1").collect()
    # the first edge is a loop at 0, training ends at 800, messages at 640: the edges at 700 and 800 are training pairs
    assert sorted((r["split"], r["u"]) for r in got) == [("test", 9), ("train", 6), ("train", 7), ("val", 8)]


def test_common_neighbours_of_given_pairs(spark):
    star = [(0, i) for i in range(1, 30)] + [(1, 2), (2, 3)]
    e = temporal.to_undirected(spark.createDataFrame(star, "src long, dst long"))
    every = {(r["u"], r["v"]): (r["n"], round(r["adamic_adar"], 9)) for r in graph.common_neighbours(e).collect()}
    asked = [(1, 3), (0, 2), (5, 6), (0, 9), (1, 1000)]
    got = {(r["u"], r["v"]): (r["n"], round(r["adamic_adar"], 9)) for r in graph.common_neighbours_of(spark.createDataFrame(asked, "u long, v long"), e).collect()}
    assert got == {p: every.get(p, (0, 0.0)) for p in asked}


def test_cascade_times_of_a_hot_item(spark, monkeypatch):
    rows = [("hot", float(i * i % 1_000)) for i in range(700)] + [(f"i{k % 9}", float(k)) for k in range(60)] + [("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "item_id string, delay_min double").repartition(4)
    want = sorted(map(tuple, series.cascade_times(df).collect()))
    monkeypatch.setattr(series, "HOT_ROWS", 50)
    monkeypatch.setattr(series.quantiles, "__defaults__", (50, 16, 30))
    got = sorted(map(tuple, series.cascade_times(df).collect()))
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1:] == pytest.approx(w[1:]) for g, w in zip(got, want))


def test_a_task_holds_few_rows_of_a_large_graph(spark, monkeypatch):
    from weftline.operators import builders

    monkeypatch.setattr(builders, "EDGE_ROWS", 100, raising=False)
    nodes = spark.range(4_000).select(F.lit(1).alias("item_id"), F.col("id").cast("int").alias("node"), F.col("id").alias("uid"), F.lit(0.0).alias("delay_min"), F.array(F.lit(1.0)).alias("profile"))
    edges = nodes.filter("node > 0").select("item_id", F.floor(F.col("node") / 2).cast("int").alias("parent"), F.col("node").alias("child"))
    made = builders.propagation_graph(nodes, edges, nodes.select("item_id", F.array(F.lit(0.5)).alias("x")).distinct())[1]
    at = made.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    assert at[0] <= 600 and at[1] == made.distinct().count() == 2 * (2 * 3_999 - 1)  # 1 hangs below the root already
    assert made.filter("src = dst").isEmpty()
