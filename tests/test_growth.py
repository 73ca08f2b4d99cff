"""Steps whose cost must grow with the input: work dealt over tasks, tables worked out once, bounded pieces."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from weftline.functions.lineage import counted
from weftline.functions.scalars import permutation_keys, permuted
from weftline.operators import graph, models, protocols, temporal
from weftline.plans import source_queries
from weftline.sources import readers


def test_counted_rows_come_from_several_tasks(spark):
    one = spark.createDataFrame([(1, 25_000), (2, 0), (3, 7)], "w int, n int").coalesce(1)
    got = counted(one, F.col("n"), "i", rows=1_000)
    assert {(r["w"], r["lo"], r["hi"], r["n"]) for r in got.groupBy("w").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.countDistinct("i").alias("n")).collect()} == {(1, 0, 24_999, 25_000), (3, 0, 6, 7)}
    assert got.count() == 25_007 and got.select(F.spark_partition_id()).distinct().count() > 4


def test_permutation_by_given_keys_is_the_same(spark):
    x = spark.range(97).withColumn("w", F.lit(5))
    keys = x.select("id", "w", permutation_keys(F.lit(97), "w", seed=3).alias("keys"))
    places = [r[0] for r in keys.select(permuted(F.col("id"), F.lit(97), "w", seed=3, keys=F.col("keys"))).collect()]
    assert places == [r[0] for r in x.select(permuted(F.col("id"), F.lit(97), "w", seed=3)).collect()] and sorted(places) == list(range(97))


def test_entropy_block_works_out_entropies_once(spark, monkeypatch):
    calls, real = [], temporal.local_entropy
    monkeypatch.setattr(temporal, "local_entropy", lambda *a, **k: calls.append(a) or real(*a, **k))
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 5), (1, 2, 40), (4, 4, 41)], "src long, dst long, ts long")
    got = {r["node"]: r["x"] for r in models.entropy_block(edges, 10).collect()}
    assert len(calls) == 1 and set(got) == {1, 2, 3, 4} and got[4][0] == pytest.approx(0) and got[2][1] > got[1][1]


def test_common_neighbours_shuffle_no_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(250)} | {(0, i) for i in range(1, 60)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for u in near:
        for v in near:
            if u < v and (both := near[u] & near[v]):
                want[u, v] = (len(both), pytest.approx(sum(1 / math.log(len(near[m])) for m in both)))
    for rows, make in ((2_000_000, int), (50, int), (5, int), (50, lambda i: f"n{i:02}")):
        monkeypatch.setattr(graph, "MEET_ROWS", rows)
        e = temporal.to_undirected(spark.createDataFrame([(make(a), make(b)) for a, b in pairs], "src long, dst long" if make is int else "src string, dst string"))
        found = graph.common_neighbours(e, blocks=3)
        got = found.collect()
        assert len(got) == len(want) and {(r["u"], r["v"]): (r["n"], r["adamic_adar"]) for r in got} == {(make(a), make(b)): x for (a, b), x in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [u#" not in plan  # pairs are not grouped, so not shuffled


def test_lenient_json_passes_on_bounded_pieces(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"f{i:02}.json").write_text('[{"a": {"b": [%d, "%s"]}}]' % (i, "x" * 1_000) if i % 5 else "{broken")
    monkeypatch.setattr(readers, "HELD_FILES", 3)
    got = readers.lenient_json(spark, str(tmp_path)).collect()
    assert len(got) == 40 and sum(r["text"] is None for r in got) == 8
    assert [r["file"][-8:] for r in readers.lenient_json(spark, str(tmp_path), "f3[0-9]").collect() if r["text"] is None] == ["f30.json", "f35.json"]


def test_files_of_a_thread_are_parsed_once(spark, tmp_path, monkeypatch):
    calls, real = [], readers.lenient_json
    monkeypatch.setattr(readers, "lenient_json", lambda s, p, names="": calls.append(names) or real(s, p, names))
    path = source_queries.thread_files(spark, SMALL, str(tmp_path / "t"))
    items, nodes, edges = readers.threads(spark, path)
    assert sorted(calls) == ["annotation", "source-tweets|reactions", "structure"]
    for df in (nodes, edges):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert items.count() == len({r["item_id"] for r in nodes.select("item_id").distinct().collect()})


def test_rings_are_cut_into_slices(spark, monkeypatch):
    members = spark.range(300).select(F.lit("a").alias("attr"), (F.col("id") % 2).cast("string").alias("value"), F.col("id").alias("item_id"))
    whole = {tuple(r) for r in graph.random_rings(members, 3).collect()}
    monkeypatch.setattr(graph, "RING_ROWS", 20)
    cut = [tuple(r) for r in graph.random_rings(members, 3).collect()]
    assert len(cut) == 900 and set(cut) == whole
    assert {tuple(r) for r in graph.attribute_pairs(members, 100).collect()} == {p for a, b in graph.random_rings(members, 100).collect() for p in ((a, b), (b, a))}


def test_graph_means_carry_no_vectors_on_edges(spark, monkeypatch):
    monkeypatch.setattr(models, "EDGE_ROWS", 10)
    rnd = random.Random(2)
    x = {(g, i): [rnd.random(), rnd.random()] for g in range(3) for i in range(12)}
    edges = {(g, *rnd.sample(range(13), 2)) for g in range(3) for _ in range(40)}  # node 12 has no row
    got = models.graph_means(spark.createDataFrame([(g, i, v) for (g, i), v in x.items()], "graph_id long, node int, x array<double>"), spark.createDataFrame(list(edges), "graph_id long, src int, dst int"))
    for r in got.collect():
        near = {}
        for a, b in [(a, b) for g, a, b in edges if g == r["graph_id"] and a < 12] + [(i, i) for i in range(12)]:
            near.setdefault(b, []).append(x[r["graph_id"], a])
        means = [[sum(v[k] for v in vs) / len(vs) for k in (0, 1)] for vs in near.values()]
        assert r["x"] == pytest.approx([sum(m[k] for m in means) / len(means) for k in (0, 1)])


def counting(edges):
    """edges, and a count of the rows that are worked out."""
    seen = edges.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return edges.mapInArrow(run, edges.schema), seen


def test_link_tasks_read_their_edges_few_times(spark):
    rnd = random.Random(3)
    e = spark.createDataFrame([(*rnd.sample(range(40), 2), 60 * i) for i in range(400)], "src long, dst long, ts long")
    counted_edges, seen = counting(e)
    temporal.link_samples(counted_edges, new_only=False).count()
    assert seen.value <= 3 * 400
    counted_edges, seen = counting(e)
    protocols.window_sweep(counted_edges, [3600], (1,), {"new_only": False}).count()
    assert seen.value == 400


def test_methods_share_their_walks(spark, monkeypatch):
    calls, real = [], models.walk_vectors
    monkeypatch.setattr(models, "walk_vectors", lambda *a, **k: calls.append(k) or real(*a, **k))
    e = spark.createDataFrame([(i % 7, (i * 3 + 1) % 8, 60 * i) for i in range(60)], "src long, dst long, ts long")
    walking, walked = {"num_walks": 1, "length": 3, "size": 2, "window": 2, "partitions": 1}, {}
    for method in ("walks", "time_weighted"):
        assert models.node_features(method, e, 3600, walked=walked, **walking).count() == 8
    assert len(calls) == 1
