"""Protocols that end in metrics: methods, sweeps, ablations and suites on identical splits.

A link task is the pairs [split, u, v, label] of temporal.link_samples and the edges that may pass messages. Runs are named
by arm and seed; every arm of a seed sees the same pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import ordered_index, written
from weftline.operators import builders, metrics, models, temporal

METRICS = ("auc", "accuracy", "f1", "precision", "recall")


def link_task(edges: DataFrame, seed: int, **options) -> tuple[DataFrame, DataFrame]:
    """(pairs, message edges), both written; options are those of temporal.link_samples. edges should be written too."""
    shares = {k: v for k, v in options.items() if k in ("train", "val", "mp_share")}
    return written(temporal.link_samples(edges, seed=seed, **options)), written(temporal.message_edges(edges, **shares))


def spread_over(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """features [node, x], with zeros for nodes that have none."""
    size = features.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    return nodes.join(features, "node", "left").select("node", F.coalesce("x", F.array_repeat(F.lit(0.0), size)).alias("x"))


def link_scores(pairs: DataFrame, features: DataFrame, kind: str = "logistic", **options) -> DataFrame:
    """[u, v, label, score, predicted] of the test pairs, by a model on the train pairs' products."""
    return models.link_predictor(pairs.filter("split = 'train'"), pairs.filter("split = 'test'"), features, kind, **options)


def named(predictions: DataFrame, arm: str, seed: int) -> DataFrame:
    return predictions.select(F.lit(arm).alias("arm"), F.lit(seed).alias("seed"), "label", "score", "predicted")


def compare_methods(edges: DataFrame, methods: dict[str, dict] | None = None, seeds: tuple[int, ...] = (0,), window_seconds: int = 2_592_000, task: dict | None = None, **options) -> DataFrame:
    """[arm, seed, auc, accuracy, f1, precision, recall] of every method's features on the same link task; methods maps names of
    models.FEATURES to their options."""
    parts = []
    edges = written(edges.select("src", "dst", "ts"))
    nodes = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    for seed in seeds:
        pairs, messages = link_task(edges, seed, **(task or {}))
        walked: dict[tuple, DataFrame] = {}
        for method, own in (methods or {m: {} for m in models.FEATURES}).items():
            x = written(spread_over(nodes, models.node_features(method, messages, window_seconds, walked=walked, **own)))
            parts.append(written(named(link_scores(pairs, x, **options), method, seed)))
    return models.compared(reduce(DataFrame.unionByName, parts))


def window_entropy(edges: DataFrame, windows: list[int], alpha: float = 0.6, lam: float = 1.2) -> DataFrame:
    """[window_seconds, node, lne_last, lne_tw] for every window length: edges are cut by all lengths in one pass, and one neighbour
    table and one aggregate serve them all."""
    t0 = edges.agg(F.min("ts").alias("t0"))
    grid = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in windows])).alias("window_seconds")
    cut = edges.join(F.broadcast(t0), how="cross").select("src", "dst", "ts", "t0", grid)  # one row
    w = F.struct("window_seconds", F.floor((F.col("ts") - F.col("t0")) / F.col("window_seconds")).cast("int").alias("w")).alias("w")
    snaps = written(cut.select(w, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
    tops = snaps.groupBy("w.window_seconds").agg(F.max("w.w").alias("top"))
    h = temporal.local_entropy(snaps, alpha).select("w.window_seconds", F.col("w.w").alias("at"), "node", "h").join(F.broadcast(tops), "window_seconds")  # a row a length
    return h.groupBy("window_seconds", "node").agg(
        F.sum(F.when(F.col("at") == F.col("top"), F.col("h")).otherwise(0.0)).alias("lne_last"),
        F.sum(F.exp(-lam * (F.col("top") - F.col("at"))) * F.col("h")).alias("lne_tw"),
    )


def ratio_samples(edges: DataFrame, ratios: list[float], seed: int = 0, **options) -> DataFrame:
    """[ratio, split, u, v, label] for every ratio of negatives: one set of draws, of which each ratio takes its first ones."""
    drawn = written(temporal.link_samples(edges, ratio=max(ratios), seed=seed, numbered=True, **options))
    positive = drawn.filter("label = 1").groupBy("split").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio")
    x = drawn.join(F.broadcast(positive), "split").select(grid, "split", "u", "v", "label", "i", "n")  # three rows
    return x.filter((F.col("label") == 1) | (F.col("i") < F.bround(F.col("ratio") * F.col("n")))).drop("i", "n")


def window_sweep(edges: DataFrame, windows: list[int], seeds: tuple[int, ...] = (0,), task: dict | None = None, **options) -> DataFrame:
    """[arm, metric, mean, sd, lo, hi, values]: the link task by the entropy features of each window length; the pairs stay the same."""
    parts = []
    edges = written(edges.select("src", "dst", "ts"))
    nodes = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    for seed in seeds:
        pairs, messages = link_task(edges, seed, **(task or {}))
        every = written(window_entropy(messages, windows))
        for window in windows:
            x = every.filter(F.col("window_seconds") == window).select("node", F.array("lne_last", "lne_tw").alias("x"))
            parts.append(written(named(link_scores(pairs, written(spread_over(nodes, models.unit_range(x))), **options), f"window={window}", seed)))
    return models.summary(models.compared(reduce(DataFrame.unionByName, parts)), ["arm"], list(METRICS))


def ratio_sweep(edges: DataFrame, ratios: list[float], features: DataFrame, seeds: tuple[int, ...] = (0,), task: dict | None = None, **options) -> DataFrame:
    """[arm, metric, mean, sd, lo, hi, values]: the link task with each ratio of negatives, by the same features [node, x]."""
    parts = []
    for seed in seeds:
        every = written(ratio_samples(edges, ratios, seed, **(task or {})))
        for r in ratios:
            parts.append(written(named(link_scores(every.filter(F.col("ratio") == float(r)), features, **options), f"ratio={r}", seed)))
    return models.summary(models.compared(reduce(DataFrame.unionByName, parts)), ["arm"], list(METRICS))


def block_ablation(rows: DataFrame, names: list[str], kind: str = "logistic", k: int = 5, seeds: tuple[int, ...] = (0,), only: bool = False, **options) -> DataFrame:
    """[arm, seed, auc, .., recall, loss]: out-of-fold metrics of all blocks and of each variant of models.ablations, on the same folds;
    loss is the area that the variant lacks against all blocks."""
    variants = written(models.ablations(rows, names, only))
    arms = ["all", *[("only " if only else "no ") + n for n in names]]
    parts = []
    for arm in arms:
        x = written(models.blocks(variants.filter(F.col("variant") == arm), names))
        parts += [written(named(models.out_of_fold(x, kind, k, seed, **options), arm, seed)) for seed in seeds]
    got = written(models.compared(reduce(DataFrame.unionByName, parts)))
    full = got.filter("arm = 'all'").select("seed", F.col("auc").alias("full"))
    return got.join(F.broadcast(full), "seed").withColumn("loss", F.col("full") - F.col("auc")).drop("full")  # a row a seed


def node_suites(nodes: DataFrame, graphs: dict[str, DataFrame], group: str | None = None, seeds: tuple[int, ...] = (0, 1), test: float = 0.2, val: float = 0.1, **options) -> DataFrame:
    """[suite, variant, seed, auc, .., recall] of node classifiers on [node, label, x], changing one thing at a time from the first graph,
    a stratified split and all edges: the kind of graph, the split (whole groups of the column), the scope of edges, the
    hops (granularity) and, across all variants, the seed. Rows without a label pass messages only.
    """
    x = written(nodes.select("node", "x"))
    known = written(nodes.filter("label IS NOT NULL"))
    first = next(iter(graphs.values()))
    base = {"graph": first, "split": "stratified", "scope": "all", "hops": 1}
    plans: list[tuple[str, str, dict]] = [("graph", name, {"graph": g}) for name, g in graphs.items()]
    plans += [("split", "grouped", {"split": "grouped"})] if group else []
    plans += [("scope", "labelled", {"scope": "labelled"}), ("hops", "none", {"hops": 0}), ("hops", "2", {"hops": 2})]
    parts = []
    for seed in seeds:
        splits = {"stratified": written(metrics.stratified(known, "node", "label", test, val, seed).select("node", "label", "split"))}
        if group:
            splits["grouped"] = written(metrics.grouped_split(known, group, test, val, seed).select("node", "label", "split"))
        for suite, variant, change in plans:
            p = base | change
            e = builders.within(p["graph"], known.select("node")) if p["scope"] == "labelled" else p["graph"]
            got = models.node_classifier(x, e, splits[p["split"]], p["hops"], **options)
            parts.append(written(named(got, f"{suite}/{variant}", seed)))
    got = models.compared(reduce(DataFrame.unionByName, parts))
    return got.select(F.split("arm", "/")[0].alias("suite"), F.split("arm", "/")[1].alias("variant"), "seed", *METRICS)


def seed_sensitivity(runs: DataFrame, by: list[str], metric: str = "auc") -> DataFrame:
    """[by, seeds, mean, spread]: how far a variant's metric moves with nothing but the seed."""
    return runs.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg(metric).alias("mean"), (F.max(metric) - F.min(metric)).alias("spread"))


def split_predictions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scored pairs + side: `linked` at or above the threshold, else `unlinked`, and their place by falling score from 0."""
    placed = ordered_index(scored, F.desc("score"), F.col("u"), F.col("v"), name="place")
    return placed.withColumn("side", F.when(F.col("score") >= threshold, "linked").otherwise("unlinked"))


def run_suite(make: dict[str, Callable[[int], DataFrame]], seeds: tuple[int, ...]) -> DataFrame:
    """[arm, seed, auc, .., recall] of named functions that take a seed and give [label, score, predicted]."""
    parts = [written(named(f(seed), arm, seed)) for seed in seeds for arm, f in make.items()]
    return models.compared(reduce(DataFrame.unionByName, parts))
