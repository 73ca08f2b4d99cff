"""Fitted models and the protocols around them: folds, arms, sweeps, ablations, comparisons.

Rows are [id, label INT, x ARRAY<DOUBLE>]; predictions [.., id, label, score, predicted]. Fits are pyspark.ml's; a scaler is
fitted in each fold on its training rows alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import written
from weftline.functions.scalars import ratio
from weftline.operators.metrics import auc, binary, folds


def estimator(kind: str, size: int, n: int, seed: int = 0, cost: float = 1.0, rounds: int = 200, hidden: int = 32):
    """svm (hinge loss, cost as 1 / (cost n)), boosted trees, logistic, or a one-hidden-layer network, on a scaled column."""
    made = {
        "svm": lambda: LinearSVC(featuresCol="scaled", labelCol="label", regParam=1.0 / (cost * max(n, 1)), maxIter=100),
        "boosted": lambda: GBTClassifier(featuresCol="scaled", labelCol="label", maxIter=rounds, maxDepth=3, seed=seed),
        "logistic": lambda: LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1.0 / (cost * max(n, 1))),
        "network": lambda: MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[size, hidden, 2], seed=seed, maxIter=100),
    }
    if kind not in made:
        raise ValueError(f"unknown model {kind!r}; one of {', '.join(made)}")
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), made[kind]()])


def fit_predict(train: DataFrame, test: DataFrame, kind: str, **options) -> DataFrame:
    """test's columns but x + score (probability, or the margin of an svm) and predicted."""
    vec = lambda df: df.withColumn("features", array_to_vector("x"))
    n, size = train.agg(F.count("*"), F.max(F.size("x"))).first()
    out = estimator(kind, size or 0, n, **options).fit(vec(train)).transform(vec(test))
    raw = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
    return out.select(*[c for c in test.columns if c != "x"], F.element_at(raw, 2).alias("score"), F.col("prediction").cast("int").alias("predicted"))


def out_of_fold(rows: DataFrame, kind: str, k: int = 5, seed: int = 0, **options) -> DataFrame:
    """[id, label, fold, score, predicted]: each row scored by the model of the folds that it isn't in."""
    dealt = written(folds(rows, "id", "label", k, seed))
    parts = [fit_predict(dealt.filter(F.col("fold") != i).drop("fold"), dealt.filter(F.col("fold") == i), kind, **options) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """[by, accuracy, f1, precision, recall] of the positive class by predicted label."""
    scored = predictions.withColumn("score", F.col("predicted").cast("double"))
    return binary(scored, 0.5, by).select(*by, "accuracy", "f1", "precision", "recall")


def summary(metrics: DataFrame, by: list[str], columns: list[str], population: bool = True) -> DataFrame:
    """[by, metric, mean, sd, lo, hi, values] over the other columns' rows; no number counts as missing."""
    long = metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for c in columns])).alias("m")).select(*by, "m.*")
    sd = F.stddev_pop("v") if population else F.stddev_samp("v")
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), sd.alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sort_array(F.collect_list("v")).alias("values"))  # a value a fold or seed


def blocks(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """[id, label, x] from [id, label, a struct column of arrays `blocks`]: the chosen blocks one after the other."""
    return rows.select("id", "label", F.concat(*[F.col(f"blocks.{b}") for b in chosen]).alias("x"))


def arms(rows: DataFrame, combinations: dict[str, list[str]], kinds: list[str], seeds: list[int], k: int = 5, **options) -> DataFrame:
    """[arm, seed, id, label, fold, score, predicted] of every combination of blocks, model and seed, on the same folds for a seed."""
    parts = []
    for name, chosen in combinations.items():
        x = written(blocks(rows, chosen))
        for kind in kinds:
            for seed in seeds:
                parts.append(out_of_fold(x, kind, k, seed, **options).select(F.lit(f"{name}/{kind}").alias("arm"), F.lit(seed).alias("seed"), "id", "label", "fold", "score", "predicted"))
    return reduce(DataFrame.unionByName, parts)


def compared(predictions: DataFrame) -> DataFrame:
    """[arm, seed, auc, accuracy, f1, precision, recall] of [arm, seed, label, score, predicted]: methods on identical splits."""
    return auc(predictions, ["arm", "seed"]).join(fold_metrics(predictions, ["arm", "seed"]), ["arm", "seed"])


def ablations(rows: DataFrame, names: list[str], only: bool = False) -> DataFrame:
    """[variant, id, label, blocks]: all blocks, and for each name the block zeroed, or (only) all others zeroed."""
    zero = lambda b: F.transform(F.col(f"blocks.{b}"), lambda _: F.lit(0.0)).alias(b)
    keep = lambda b: F.col(f"blocks.{b}").alias(b)
    parts = [rows.select(F.lit("all").alias("variant"), "id", "label", F.struct(*[keep(b) for b in names]).alias("blocks"))]
    for name in names:
        struct = F.struct(*[zero(b) if (b == name) != only else keep(b) for b in names])
        parts.append(rows.select(F.lit(("only " if only else "no ") + name).alias("variant"), "id", "label", struct.alias("blocks")))
    return reduce(DataFrame.unionByName, parts)


def assembled(rows: DataFrame, names: list[str], split: str = "split") -> DataFrame:
    """rows' id, label, split + blocks, each element standardised by the training rows alone; no number and no spread give 0."""
    long = rows.select("id", split, F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"blocks.{b}").alias("v")) for b in names])).alias("b")).select("id", split, "b.block", F.posexplode("b.v").alias("pos", "v"))
    good = F.when(F.isnan("v") | (F.abs("v") == float("inf")) | F.col("v").isNull(), 0.0).otherwise(F.col("v"))
    long = long.withColumn("v", good)
    stats = long.filter(F.col(split) == "train").groupBy("block", "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = long.join(F.broadcast(stats), ["block", "pos"], "left").select("id", "block", "pos", F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))  # a row an element
    back = z.groupBy("id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda p: p["z"]).alias("x"))
    wide = back.groupBy("id").pivot("block", names).agg(F.first("x"))
    return rows.select("id", "label", split).join(wide, "id").select("id", "label", split, F.struct(*names).alias("blocks"))


def sweep(snaps: DataFrame, alphas: list[float], lams: list[float]) -> DataFrame:
    """[alpha, lam, node, lne_tw] for all grid points at once: one neighbour table, one aggregate with a column an alpha."""
    from weftline.operators.temporal import neighbours, order_entropy, shannon

    near = written(neighbours(snaps))
    deg = near.groupBy("w", F.col("node").alias("other")).agg(F.sum(F.when(F.col("node") == F.col("other"), 2).otherwise(1)).alias("x"))
    power = lambda a: F.sum(F.col("x") * F.ln("x")) if abs(a - 1) < 1e-8 else F.sum(F.pow("x", F.lit(a)))
    sums = near.join(deg, ["w", "other"]).groupBy("w", "node").agg(F.sum("x").alias("s"), *[power(a).alias(f"a{i}") for i, a in enumerate(alphas)])
    h = [shannon(F.col(f"a{i}"), F.col("s")) if abs(a - 1) < 1e-8 else order_entropy(F.col(f"a{i}"), F.col("s"), a) for i, a in enumerate(alphas)]
    long = sums.select("w", "node", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), x.alias("h")) for a, x in zip(alphas, h)])).alias("g")).select("w", "node", "g.*")
    top = snaps.agg(F.max("w").alias("top"))
    grid = long.join(F.broadcast(top), how="cross").withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lams])))  # one row
    return grid.groupBy("alpha", "lam", "node").agg(F.sum(F.exp(-F.col("lam") * (F.col("top") - F.col("w"))) * F.col("h")).alias("lne_tw"))


def binning_sweep(gap: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """[n_bins, hi, account_id, H_1]: the entropy of log-binned gaps for every binning, from one pass over the gaps."""
    from weftline.operators.series import entropy_bits

    x = F.col("dt").cast("double")

    def at(n: int, hi: float) -> Column:
        edges = F.array(*[F.lit(hi ** (i / n)) for i in range(n)])
        return F.when(x <= 0, 0).when((x >= 1) & (x <= hi), F.size(F.filter(edges, lambda e: e <= x)))

    points = F.array(*[F.struct(F.lit(n).alias("n_bins"), F.lit(float(hi)).alias("hi"), at(n, hi).alias("bin")) for n, hi in grid])
    counts = gap.select("account_id", F.explode(points).alias("p")).select("account_id", "p.*").filter("bin IS NOT NULL").groupBy("n_bins", "hi", "account_id", "bin").agg(F.count("*").alias("n"))
    return counts.groupBy("n_bins", "hi", "account_id").agg(entropy_bits(1.0, F.col("n")).alias("H_1"))


def tidy(results: DataFrame, places: int = 4) -> DataFrame:
    """[run_id, a column a metric] of long results, rounded."""
    names = [r[0] for r in results.select("metric").distinct().orderBy("metric").collect()]  # a row a metric
    return results.groupBy("run_id").pivot("metric", names).agg(F.round(F.first("value"), places))


def link_predictor(train: DataFrame, test: DataFrame, nodes: DataFrame, kind: str = "logistic", **options) -> DataFrame:
    """[u, v, label, score, predicted] of test pairs: a model on the element-wise product of both ends."""
    from weftline.operators.passing import pair_features

    pairs = lambda df: written(pair_features(df.select("u", "v", "label"), nodes).select("u", "v", "label", "x"))
    return fit_predict(pairs(train), pairs(test), kind, **options)


def node_classifier(nodes: DataFrame, edges: DataFrame, labels: DataFrame, hops: int = 2, kind: str = "logistic", **options) -> DataFrame:
    """[id, label, score, predicted] of test nodes: a model on features propagated hops times without weights (so fitted once).

    labels are [node, label, split]; features of all hops stand one after the other.
    """
    from weftline.operators.graph import gcn

    h, x = nodes, nodes.select("node", "x")
    for i in range(hops):
        h = written(gcn(h, edges))
        x = x.join(h.select("node", F.col("x").alias("more")), "node").select("node", F.concat("x", "more").alias("x"))
    rows = written(x.join(labels, "node").select(F.col("node").alias("id"), "label", "split", "x"))
    return fit_predict(rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split"), kind, **options)


#: Edges that a task of graph_means holds.
EDGE_ROWS = 250_000


def graph_means(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[graph_id, x]: each graph's mean of its receivers' means over [graph_id, src, dst] and loops.

    A sender counts 1 / senders for each of its receivers, so vectors are added once a node, by these weights, and no edge
    carries one. Edges are parted by count, as packed partitions of a size in bytes would hold millions.
    """
    from weftline.operators.graph import _mean

    loops = nodes.select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"))
    every = written(edges.select("graph_id", "src", "dst").unionByName(loops))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every.count() // EDGE_ROWS))
    known = every.repartition(parts, "graph_id", "src").join(loops.select("graph_id", "src"), ["graph_id", "src"], "left_semi")
    links = known.repartition(parts, "graph_id", "dst")
    senders = links.groupBy("graph_id", "dst").agg(F.count("*").alias("n"))
    weights = links.join(senders, ["graph_id", "dst"]).repartition(parts, "graph_id", "src").groupBy("graph_id", F.col("src").alias("node")).agg(F.sum(1 / F.col("n")).alias("wt"))
    receivers = senders.groupBy("graph_id").agg(F.count("*").alias("n"))
    total = _mean(nodes.select("graph_id", "node", "x").join(weights, ["graph_id", "node"]), ["graph_id"], F.col("wt"), True)
    return total.join(receivers, "graph_id").select("graph_id", F.transform("x", lambda v: v / F.col("n")).alias("x"))


def graph_classifier(nodes: DataFrame, edges: DataFrame, labels: DataFrame, kind: str = "logistic", **options) -> DataFrame:
    """[id, label, score, predicted] of test graphs: a model on each graph's mean of features propagated once over [graph_id, src, dst]."""
    rows = written(graph_means(nodes, edges).join(labels, "graph_id").select(F.col("graph_id").alias("id"), "label", "split", "x"))
    return fit_predict(rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split"), kind, **options)


def suite(name: str, variants: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """[suite, variant, label, score, predicted, ..] of named variants, each a function that gives predictions."""
    parts = [make().withColumns({"suite": F.lit(name), "variant": F.lit(v)}) for v, make in variants.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def plane(train: DataFrame, rows: DataFrame, k: int = 2) -> DataFrame:
    """[id, pc ARRAY]: rows on the first k principal axes of the centred training rows."""
    mean = [r["m"] for r in train.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()]  # a row an element
    centre = F.array(*[F.lit(float(m)) for m in mean])
    vec = lambda df: df.withColumn("features", array_to_vector(F.zip_with("x", centre, lambda a, b: a - b)))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vec(train))
    return model.transform(vec(rows)).select("id", vector_to_array("pc").alias("pc"))


def explained(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """[components]: principal axes that hold this share of the variance."""
    size = rows.agg(F.max(F.size("x"))).first()[0]
    model = PCA(k=size, inputCol="features", outputCol="pc").fit(rows.select(array_to_vector("x").alias("features")))
    so_far, k = 0.0, 0
    for v in model.explainedVariance.toArray():
        if so_far >= share:
            break
        so_far, k = so_far + float(v), k + 1
    return rows.sparkSession.createDataFrame([(k,)], "components int")


def node_vectors(walks: DataFrame, size: int = 128, window: int = 10, seed: int = 0, partitions: int = 8) -> DataFrame:
    """[node STRING, x]: skip-gram vectors of [walk, start, step, node]; the fit is hierarchical softmax, not negative sampling."""
    lists = walks.groupBy("walk", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", F.col("node").cast("string").alias("n")))), lambda r: r["n"]).alias("words"))  # one walk
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, inputCol="words", numPartitions=partitions).fit(lists)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("x"))


def token_means(tokens: DataFrame, first_only: bool = False) -> DataFrame:
    """[post, x] of [post, token_pos, vec, mask]: the mean over tokens whose mask is on, zeros without one, or the first token's vector."""
    if first_only:
        return tokens.groupBy("post").agg(F.min_by("vec", "token_pos").alias("x"))
    parts = tokens.select("post", "mask", F.posexplode("vec").alias("pos", "v")).groupBy("post", "pos").agg(ratio(F.sum(F.when(F.col("mask") != 0, F.col("v"))), F.count_if(F.col("mask") != 0)).alias("m"))
    return parts.groupBy("post").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("x"))


def encoded(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 256) -> DataFrame:
    """texts + vec ARRAY<FLOAT> by a user's encoder: load() is called once a task and gives the function that takes a batch of texts."""
    names = texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for df in batches:
            got: list[list[float]] = []
            for i in range(0, len(df), batch):
                got += encode([t or "" for t in df[text].iloc[i : i + batch]])
            yield df.assign(vec=got)[[*names, "vec"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + ", vec array<float>"
    return texts.mapInPandas(run, schema)


def joined_vectors(graph: DataFrame, text: DataFrame, key: str, graph_size: int, text_size: int, use_graph: bool = True, use_text: bool = True) -> DataFrame:
    """[key, x]: the graph vector and the text vector one after the other; a missing one is zeros, a branch can be left out."""
    both = graph.select(key, F.col("x").alias("g")).join(text.select(key, F.col("x").alias("t")), key, "full")
    zero = lambda n: F.array_repeat(F.lit(0.0), n)
    parts = [F.coalesce("g", zero(graph_size))] * use_graph + [F.coalesce("t", zero(text_size))] * use_text
    return both.select(key, F.concat(*parts).alias("x"))


#: `time_weighted` is the entropy block with the walk vectors beside it.
FEATURES = ("degree", "pagerank", "walks", "static_entropy", "entropy", "time_weighted")


def node_features(method: str, edges: DataFrame, window_seconds: int = 2_592_000, walked: dict[tuple, DataFrame] | None = None, **options) -> DataFrame:
    """[node, x] by the named method, each element scaled to [0, 1]; a constant one is 0.

    entropy: the last window's entropy, the time-weighted one, and the last time-weighted value of the whole network, which
    is the same for all nodes. time_weighted: these and the vectors of `walks`, zeros for a node without either. walked: walk
    vectors of the same edges by options, which calls share.
    """
    from weftline.operators import graph, temporal

    if method not in FEATURES:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(FEATURES)}")
    walked = {} if walked is None else walked

    def vectors(**walking) -> DataFrame:
        named = tuple(sorted(walking.items()))
        if named not in walked:
            walked[named] = written(walk_vectors(edges, **walking))
        return walked[named]

    if method == "degree":
        x = temporal.to_undirected(edges).groupBy(F.col("dst").alias("node")).agg(F.array(F.count("*").cast("double")).alias("x"))
    elif method == "pagerank":
        x = graph.pagerank(temporal.to_undirected(edges), **options).select("node", F.array("rank").alias("x"))
    elif method == "walks":
        x = vectors(**options)
    elif method == "static_entropy":
        x = temporal.static_entropy(edges, **options).select("node", F.array("h").alias("x"))
    else:
        walking = {k: options.pop(k) for k in list(options) if k in ("num_walks", "length", "p", "q", "size", "window", "seed", "partitions")}
        x = entropy_block(edges, window_seconds, **options)
        if method == "time_weighted":
            both = vectors(**walking)
            size = both.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
            x = joined_vectors(x, both, "node", 3, size)
    return unit_range(written(x))


def walk_vectors(edges: DataFrame, num_walks: int = 10, length: int = 80, p: float = 1.0, q: float = 1.0, seed: int = 0, **options) -> DataFrame:
    """[node, x]: skip-gram vectors of walks on the undirected graph; node has the edges' type."""
    from weftline.operators import sampling, temporal

    walks = sampling.random_walks(temporal.to_undirected(edges), num_walks, length, p, q, seed)
    return node_vectors(walks, seed=seed, **options).select(F.col("node").cast(edges.schema["src"].dataType).alias("node"), "x")


def entropy_block(edges: DataFrame, window_seconds: int, alpha: float = 0.6, lam: float = 1.2) -> DataFrame:
    """[node, x]: last-window entropy, time-weighted entropy, and the network's time-weighted value in its last window."""
    from weftline.operators import temporal

    local = written(temporal.local_entropy(temporal.snapshots(edges, window_seconds), alpha))
    whole = temporal.weighted_series(temporal.summed_entropy(local), lam).agg(F.max_by("weighted_h", "w").alias("g"))
    return temporal.weighted_entropy(local, lam).join(F.broadcast(whole), how="cross").select("node", F.array("lne_last", "lne_tw", "g").alias("x"))  # one row


def unit_range(rows: DataFrame) -> DataFrame:
    """[node, x] with every element scaled to [0, 1] over all rows; a constant element becomes 0."""
    long = rows.select("node", F.posexplode("x").alias("pos", "v"))
    ends = long.groupBy("pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = long.join(F.broadcast(ends), "pos").select("node", "pos", ratio(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")).alias("v"))  # a row an element
    return scaled.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x"))


def vector_diagnostics(vectors: DataFrame) -> DataFrame:
    """[centred_norm, class_gap] of [id, x, label]: mean length of centred vectors, and the mean over elements of the gap between the two classes' means over their pooled SD."""
    long = vectors.select(F.col("id").alias("i"), "label", F.posexplode("x").alias("pos", "v"))
    long = written(long)
    mean = long.groupBy("pos").agg(F.avg("v").alias("m"))
    norms = long.join(F.broadcast(mean), "pos").groupBy("i").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("n")).agg(F.avg("n").alias("centred_norm"))  # a row an element
    by = long.groupBy("pos").agg(*[f(F.when(F.col("label") == k, F.col("v"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("s", F.var_pop))])
    gap = by.agg(F.avg(ratio(F.abs(F.col("m0") - F.col("m1")), F.sqrt((F.col("s0") + F.col("s1")) / 2))).alias("class_gap"))
    return norms.join(gap, how="cross")  # one row each
