"""Fits and protocols on planted data: bands for metrics, NumPy for decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import decomposition, models, protocols, temporal

RNG = np.random.default_rng(11)
N = 240
LABEL = np.arange(N) % 2
SIGNAL = np.column_stack([LABEL * 2.0 + RNG.standard_normal(N) * 0.8, RNG.standard_normal(N)])
NOISE = RNG.standard_normal((N, 2))


@pytest.fixture(scope="module")
def blocked(spark):
    rows = [(i, int(LABEL[i]), (SIGNAL[i].tolist(), NOISE[i].tolist())) for i in range(N)]
    return spark.createDataFrame(rows, "id long, label int, blocks struct<signal: array<double>, noise: array<double>>").cache()


def area(rows):
    pos, neg = [r["score"] for r in rows if r["label"]], [r["score"] for r in rows if not r["label"]]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


@pytest.mark.parametrize("kind", ["svm", "boosted", "logistic", "network"])
def test_models_find_the_signal_and_not_the_noise(blocked, kind):
    for block, low, high in (("signal", 0.88, 1.0), ("noise", 0.35, 0.65)):
        got = models.out_of_fold(models.blocks(blocked, [block]), kind, 2, seed=1, rounds=8).collect()
        assert sorted(r["id"] for r in got) == list(range(N)) and {r["fold"] for r in got} == {0, 1}
        assert low <= area(got) <= high
        if block == "signal":
            assert np.mean([r["predicted"] == r["label"] for r in got]) > 0.8
    with pytest.raises(ValueError):
        models.estimator("forest", 2, 10)


def test_scalers_see_training_rows_alone(spark):
    train = spark.createDataFrame([(i, i % 2, [float(i % 2)]) for i in range(40)], "id long, label int, x array<double>")
    one = models.fit_predict(train, train.filter("id < 2"), "logistic").collect()
    far = models.fit_predict(train, train.filter("id < 2").unionByName(spark.createDataFrame([(99, 1, [1e9])], train.schema)), "logistic").filter("id < 2").collect()
    assert sorted((r["id"], round(r["score"], 9)) for r in one) == sorted((r["id"], round(r["score"], 9)) for r in far)


def test_arms_share_folds(blocked):
    got = models.arms(blocked, {"S": ["signal"], "N": ["noise"], "SN": ["signal", "noise"]}, ["logistic"], [1, 2], 3).collect()
    fold = {}
    for r in got:
        assert fold.setdefault((r["seed"], r["id"]), r["fold"]) == r["fold"]
    by = {a: area([r for r in got if r["arm"] == a]) for a in {r["arm"] for r in got}}
    assert set(by) == {"S/logistic", "N/logistic", "SN/logistic"} and by["S/logistic"] > 0.88 > 0.65 > by["N/logistic"] and abs(by["SN/logistic"] - by["S/logistic"]) < 0.03


def test_ablations_end_in_metrics(blocked):
    r = {x["arm"]: x for x in protocols.block_ablation(blocked, ["signal", "noise"], k=3, seeds=(1,)).collect()}
    assert r["all"]["loss"] == 0 and r["no signal"]["loss"] > 0.25 and abs(r["no noise"]["loss"]) < 0.03
    only = {x["arm"]: x for x in protocols.block_ablation(blocked, ["signal", "noise"], k=3, seeds=(1,), only=True).collect()}
    assert only["only noise"]["auc"] == pytest.approx(r["no signal"]["auc"]) and only["only signal"]["auc"] > 0.88


def communities(n=80, per=10, seed=5):
    rng = np.random.default_rng(seed)
    edges = set()
    for i in range(n):
        for _ in range(per):
            j = int(rng.integers(0, n // 2)) * 2 + (i % 2 if rng.random() < 0.95 else 1 - i % 2)
            if i != j:
                edges.add((min(i, j), max(i, j)))
    return sorted(edges)


@pytest.fixture(scope="module")
def network(spark):
    pairs = communities()
    order = np.random.default_rng(1).permutation(len(pairs))
    return spark.createDataFrame([(*pairs[k], 1_000 * t) for t, k in enumerate(order)], "src long, dst long, ts long").cache()


def test_walk_vectors_part_communities(spark, network):
    rows = models.walk_vectors(network, 8, 12, seed=3, size=16, window=3, partitions=1).collect()
    assert len(rows) == 80
    x = {r["node"]: np.array(r["x"]) / np.linalg.norm(r["x"]) for r in rows}
    same, other = ([x[a] @ x[b] for a in x for b in x if a < b and (a + b) % 2 == k] for k in (0, 1))
    assert np.mean(same) > np.mean(other) + 0.1


def test_link_predictor_and_classifiers(spark, network):
    x = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, 0.1]) for i in range(80)], "node long, x array<double>")
    pairs, messages = protocols.link_task(network, 2, new_only=False)
    got = protocols.link_scores(pairs, x).collect()
    assert len(got) == pairs.filter("split = 'test'").count() and area(got) > 0.75
    assert 0 < messages.count() < network.count()
    sides = protocols.split_predictions(spark.createDataFrame(got), 0.5).orderBy("place").collect()
    assert [r["place"] for r in sides] == list(range(len(got))) and all((r["side"] == "linked") == (r["score"] >= 0.5) for r in sides)
    assert [r["score"] for r in sides] == sorted((r["score"] for r in got), reverse=True)
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(i, [float(i % 2 + 2 * rng.standard_normal())]) for i in range(80)], "node long, x array<double>")
    labels = spark.createDataFrame([(i, i % 2, "test" if i % 5 == 0 else "train") for i in range(80)], "node long, label int, split string")
    sym = temporal.to_undirected(network)
    hops = {h: area(models.node_classifier(nodes, sym, labels, h).collect()) for h in (0, 2)}
    assert hops[2] > 0.9 > hops[0]  # neighbours tell the community better than a node's own noisy value
    graphs = [(g, k, [float(g % 2) + 2 * float(rng.standard_normal())]) for g in range(60) for k in range(8)]
    path = spark.createDataFrame([(g, k, k + 1) for g in range(60) for k in range(7)], "graph_id long, src int, dst int")
    marks = spark.createDataFrame([(g, g % 2, "test" if g % 3 == 0 else "train") for g in range(60)], "graph_id long, label int, split string")
    assert area(models.graph_classifier(spark.createDataFrame(graphs, "graph_id long, node int, x array<double>"), path, marks).collect()) > 0.6


def test_methods_on_identical_splits(network):
    walking = {"num_walks": 4, "length": 8, "size": 8, "window": 3, "partitions": 1}
    got = {r["arm"]: r for r in protocols.compare_methods(network, {"degree": {}, "walks": walking, "time_weighted": walking}, (1,), 50_000, {"new_only": False}).collect()}
    assert set(got) == {"degree", "walks", "time_weighted"}
    assert all(0 <= r[m] <= 1 for r in got.values() for m in protocols.METRICS)
    block = models.node_features("time_weighted", network, 50_000, **walking).collect()
    assert all(len(r["x"]) == 11 and r["x"][2] == 0 and min(r["x"]) >= 0 and max(r["x"]) <= 1 for r in block)


def test_ratio_samples_are_prefixes(network):
    every = protocols.ratio_samples(network, [0.5, 1.0, 2.0], seed=4, new_only=False)
    for ratio in (0.5, 2.0):
        alone = temporal.link_samples(network, ratio=ratio, seed=4, new_only=False)
        assert sorted(every.filter(F.col("ratio") == ratio).drop("ratio").collect()) == sorted(alone.collect())


def test_window_sweep_equals_single_windows(network):
    every = protocols.window_entropy(network, [40_000, 90_000])
    for w in (40_000, 90_000):
        one = {r["node"]: (r["lne_last"], r["lne_tw"]) for r in temporal.entropy_features(temporal.snapshots(network, w)).collect()}
        got = {r["node"]: (r["lne_last"], r["lne_tw"]) for r in every.filter(F.col("window_seconds") == w).collect()}
        assert set(one) == set(got) and all(one[k] == pytest.approx(got[k]) for k in one)


def test_suites_change_one_thing(spark, network):
    rng = np.random.default_rng(9)
    nodes = spark.createDataFrame([(i, i % 2 if i % 10 else None, i % 7, [float(i % 2 + rng.standard_normal())]) for i in range(80)], "node long, label int, part int, x array<double>")
    sym = temporal.to_undirected(network).cache()
    runs = protocols.node_suites(nodes, {"given": sym, "none": sym.limit(0)}, "part", (1, 2), test=0.3)
    rows = runs.collect()
    assert {(r["suite"], r["variant"]) for r in rows} == {("graph", "given"), ("graph", "none"), ("split", "grouped"), ("scope", "labelled"), ("hops", "none"), ("hops", "2")} and len(rows) == 12
    mean = lambda s, v: np.mean([r["auc"] for r in rows if (r["suite"], r["variant"]) == (s, v)])
    assert mean("graph", "given") > mean("hops", "none") - 0.05 and mean("hops", "2") > 0.8
    assert all(r["seeds"] == 2 and 0 <= r["spread"] <= 1 for r in protocols.seed_sensitivity(runs, ["suite", "variant"]).collect())


def test_plane_and_components(spark):
    x = RNG.standard_normal((90, 3)) @ np.diag([5.0, 2.0, 0.1]) @ np.linalg.qr(RNG.standard_normal((3, 3)))[0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = np.array([r["pc"] for r in models.plane(df.filter("id < 60"), df).orderBy("id").collect()])
    centred = x - x[:60].mean(axis=0)
    axes = np.linalg.svd(centred[:60], full_matrices=False)[2][:2]
    assert np.abs(got) == pytest.approx(np.abs(centred @ axes.T), abs=1e-6)
    share = np.cumsum(np.linalg.svd(x - x.mean(axis=0))[1] ** 2)
    for least in (0.5, 0.95, 0.99999):
        assert models.explained(df.select("x"), least).first()[0] == int(np.searchsorted(share / share[-1], least) + 1)


def test_singular_spectrum_is_numpys(spark):
    x = RNG.standard_normal((70, 6)) @ np.diag([9, 4, 2, 1, 0.5, 0]) + 3
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    for centred in (True, False):
        want = np.linalg.svd(x - x.mean(axis=0) * centred, compute_uv=False)
        got = [r["sigma"] for r in decomposition.singular_spectrum(df, centred).orderBy("i").collect()]
        assert got == pytest.approx(want[: len(got)], rel=1e-6) and len(got) == 6 - centred
    assert decomposition.singular_spectrum(df.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [1_024, 4])
def test_truncated_svd_is_numpys(spark, monkeypatch, whole):
    monkeypatch.setattr(decomposition.axes, "__defaults__", (0, None, whole))
    rng = np.random.default_rng(4)
    a = rng.random((60, 3)) @ rng.random((3, 30)) * 3 + (rng.random((60, 30)) < 0.2) * rng.random((60, 30))
    a[7] = 0
    entries = [(i, f"t{j:02d}", float(a[i, j])) for i in range(60) for j in range(30) if a[i, j]] + [(7, "unknown", 1.0)]
    df = spark.createDataFrame(entries, "item long, term string, weight double").repartition(4)
    got = {r["item"]: r["x"] for r in decomposition.truncated_svd(df.filter("item < 40 AND term <> 'unknown'"), df, "item", 5).collect()}
    v = np.linalg.svd(a[:40], full_matrices=False)[2][:5].T
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(5)])
    assert len(got) == 60 and all(got[i] == pytest.approx(a[i] @ v, abs=1e-6) for i in got)
    one = decomposition.truncated_svd(df.filter("term = 't01'"), df.filter("term = 't01'"), "item", 5).first()
    assert len(one["x"]) == 1
