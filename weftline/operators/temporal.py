"""Snapshots, neighbourhood entropy and its time-weighted series; splits of temporal edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import ordered_index, written
from weftline.functions.scalars import draw


def order_entropy(power_sum: Column, total: Column, alpha: float) -> Column:
    """Order-alpha entropy in nats of counts c, from sum(c^alpha) and sum(c)."""
    return (F.ln(power_sum) - alpha * F.ln(total)) / (1 - alpha)


def shannon(c_ln_c: Column, total: Column) -> Column:
    """Order-1 entropy in nats of counts c, from sum(c ln c) and sum(c)."""
    return F.ln(total) - c_ln_c / total


def snapshots(edges: DataFrame, window_seconds: int) -> DataFrame:
    """[w, u, v], u <= v: tumbling windows from the earliest ts; direction and repeats collapse, loops stay."""
    t0 = edges.agg(F.min("ts").alias("t0"))
    w = F.floor((F.col("ts") - F.col("t0")) / window_seconds).cast("int")
    return edges.join(F.broadcast(t0), how="cross").select(w.alias("w"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()  # one row


def window_spine(snaps: DataFrame) -> DataFrame:
    """[w]: every window up to the last one, the empty ones too."""
    return snaps.agg(F.max("w").alias("top")).filter("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("w"))


def neighbours(snaps: DataFrame) -> DataFrame:
    """[w, node, other]: both directions; a loop makes a node its own neighbour once."""
    ends = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")))).otherwise(
        F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))
    )
    return snaps.select("w", F.explode(ends).alias("e")).select("w", "e.node", "e.other")


def degrees(snaps: DataFrame) -> DataFrame:
    """[w, node, deg]: a loop counts twice."""
    return neighbours(snaps).groupBy("w", "node").agg(F.sum(F.when(F.col("node") == F.col("other"), 2).otherwise(1)).alias("deg"))


def node_probabilities(snaps: DataFrame) -> DataFrame:
    """[w, node, deg, p]: the degree and its share of the snapshot's total."""
    d = degrees(snaps)
    total = d.groupBy("w").agg(F.sum("deg").alias("all"))
    return d.join(total, "w").select("w", "node", "deg", (F.col("deg") / F.col("all")).alias("p"))


def snapshot_pagerank(snaps: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, iterations: int = 100) -> DataFrame:
    """[w, node, rank] of every snapshot over all nodes of the table; a node without links in a window has no row.

    Such nodes all have one rank, which is worked out at once: their mass spreads evenly, so it only adds a constant a
    window to the others. Iterates until no window changes by more than tolerance times the number of nodes.
    """
    near = written(neighbours(snaps))
    total = near.select("node").distinct().count()
    deg = near.groupBy("w", "node").agg(F.count("*").alias("d"))
    links = written(near.join(deg, ["w", "node"]))
    alone = (total - F.count("*")) / total
    base = written(deg.groupBy("w").agg(((1 - damping) / total / (1 - damping * alone)).alias("c")))
    ranks = written(deg.select("w", "node", F.lit(1.0 / max(total, 1)).alias("rank")))
    for _ in range(iterations):
        got = links.join(ranks, ["w", "node"]).groupBy("w", F.col("other").alias("node")).agg(F.sum(F.col("rank") / F.col("d")).alias("g"))
        step = ranks.join(got, ["w", "node"], "left").join(F.broadcast(base), "w")  # a row a window
        ranks = written(step.select("w", "node", F.col("rank").alias("old"), (F.col("c") + damping * F.coalesce("g", F.lit(0.0))).alias("rank")))
        worst = ranks.groupBy("w").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("x")).agg(F.max("x")).first()[0]
        ranks = ranks.drop("old")
        if worst is None or worst < tolerance * total:
            break
    return ranks


def local_entropy(snaps: DataFrame, alpha: float = 0.6, normalisation: str = "local", metric: str = "degree", **ranking) -> DataFrame:
    """[w, node, h]: order-alpha entropy over the neighbours' degrees or PageRanks; nodes without neighbours have no row (0).

    local: shares within the neighbourhood; global: shares of the snapshot, not renormalised. The neighbour table is
    written once and gives the degrees too; window totals are only worked out for global.
    """
    near = written(neighbours(snaps))
    if metric == "degree":
        x = near.groupBy("w", F.col("node").alias("other")).agg(F.sum(F.when(F.col("node") == F.col("other"), 2).otherwise(1)).alias("x"))
    elif metric == "pagerank":
        x = snapshot_pagerank(snaps, **ranking).select("w", F.col("node").alias("other"), F.col("rank").alias("x"))
    else:
        raise ValueError(f"unknown metric {metric!r}; degree or pagerank")
    if normalisation != "local":
        total = x.groupBy("w").agg(F.sum("x").alias("all"))
        x = x.join(total, "w").select("w", "other", (F.col("x") / F.col("all")).alias("x"))
    by = near.join(x, ["w", "other"]).groupBy("w", "node")
    if abs(alpha - 1) < 1e-8:
        sums = by.agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.ln("x")).alias("a"))
        return sums.select("w", "node", shannon(F.col("a"), F.col("s")).alias("h"))
    sums = by.agg(F.sum("x").alias("s"), F.sum(F.pow("x", F.lit(alpha))).alias("a"))
    h = order_entropy(F.col("a"), F.col("s"), alpha) if normalisation == "local" else F.ln("a") / (1 - alpha)
    return sums.select("w", "node", h.alias("h"))


def global_entropy(snaps: DataFrame, alpha: float = 0.6) -> DataFrame:
    """[w, h]: the sum over nodes, 0 in empty windows."""
    return summed_entropy(local_entropy(snaps, alpha))


def summed_entropy(local: DataFrame) -> DataFrame:
    """[w, h] of the nodes' [w, node, h], 0 in empty windows. The last snapshot has nodes, so it is the last window of local too."""
    h = written(local.groupBy("w").agg(F.sum("h").alias("h")))
    return window_spine(h).join(h, "w", "left").select("w", F.coalesce("h", F.lit(0.0)).alias("h"))


def memory_length(lam: float, least: float = 0.05) -> int:
    """The first step at which the time weight falls under least."""
    return math.floor(-math.log(least) / lam) + 1


def weighted_series(series: DataFrame, lam: float = 1.2) -> DataFrame:
    """[w, h, weighted_h]: exponentially weighted sum over strictly earlier windows, by steps.

    Each window adds to the later ones as long as its weight is a number above zero, a fixed number of steps, so the work
    grows with the windows and not with their square.
    """
    reach = max(1, math.ceil(745 / lam))
    series = written(series)
    ends = series.agg(F.max("w").alias("top"))
    given = series.filter("h <> 0").join(F.broadcast(ends), how="cross")  # one row
    later = given.filter("w < top").select("w", "h", F.explode(F.sequence(F.col("w") + 1, F.least(F.col("top"), F.col("w") + reach))).alias("to"))
    got = later.groupBy(F.col("to").alias("w")).agg(F.sum(F.exp(-lam * (F.col("to") - F.col("w"))) * F.col("h")).alias("g"))
    return series.join(got, "w", "left").select("w", "h", F.coalesce("g", F.lit(0.0)).alias("weighted_h"))


def entropy_features(snaps: DataFrame, alpha: float = 0.6, lam: float = 1.2) -> DataFrame:
    """[node, lne_last, lne_tw]: entropy in the last window, and the weighted sum over all windows, the last included."""
    return weighted_entropy(written(local_entropy(snaps, alpha)), lam)


def weighted_entropy(local: DataFrame, lam: float = 1.2) -> DataFrame:
    """[node, lne_last, lne_tw] of the nodes' [w, node, h], a written table."""
    last = local.agg(F.max("w").alias("top"))
    h = local.join(F.broadcast(last), how="cross")  # one row
    return h.groupBy("node").agg(
        F.sum(F.when(F.col("w") == F.col("top"), F.col("h")).otherwise(0.0)).alias("lne_last"),
        F.sum(F.exp(-lam * (F.col("top") - F.col("w"))) * F.col("h")).alias("lne_tw"),
    )


def static_entropy(edges: DataFrame, alpha: float = 0.6) -> DataFrame:
    """[node, h] on the aggregated simple graph without loops."""
    snaps = edges.filter("src <> dst").select(F.lit(0).alias("w"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return local_entropy(snaps, alpha).select("node", "h")


def undirected_pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def to_undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()


def cuts(edges: DataFrame, train: float = 0.8, val: float = 0.1, by: str = "duration") -> DataFrame:
    """[cut1, cut2, a], one row: the times up to which an edge is train and val, by share of the duration or of the edges, and the first time."""
    if by == "duration":
        dur = F.max("ts") - F.min("ts")
        return edges.agg((F.min("ts") + train * dur).alias("cut1"), (F.min("ts") + (train + val) * dur).alias("cut2"), F.min("ts").alias("a"))
    n = edges.count()
    at = ordered_index(edges.select("ts"), F.col("ts")).filter(F.col("idx").isin(int(train * n), int((train + val) * n)))
    return at.agg(F.min("ts").cast("double").alias("cut1"), F.max("ts").cast("double").alias("cut2")).join(edges.agg(F.min("ts").alias("a")), how="cross")  # one row each


def chronological_split(edges: DataFrame, train: float = 0.8, val: float = 0.1, by: str = "duration") -> DataFrame:
    """edges + split; a cut belongs to the earlier part, so tied times stay together."""
    at = F.when(F.col("ts") <= F.col("cut1"), "train").when(F.col("ts") <= F.col("cut2"), "val").otherwise("test")
    return edges.join(F.broadcast(cuts(edges, train, val, by)), how="cross").withColumn("split", at).drop("cut1", "cut2", "a")  # one row


def new_links(split: DataFrame) -> DataFrame:
    """[split, u, v]: val and test pairs that train doesn't have."""
    pair = split.filter("src <> dst").select("split", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    seen = pair.filter("split = 'train'").select("u", "v")
    return pair.filter("split <> 'train'").join(seen, ["u", "v"], "left_anti").select("split", "u", "v")


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """[node, idx], written: the different nodes by number from 0 in order."""
    return written(ordered_index(nodes.select("node").distinct(), F.col("node")))


def sample_negatives(nodes: DataFrame, forbidden: DataFrame, n: int, seed: int, rounds: int = 200) -> DataFrame:
    """[i, u, v]: the n first drawn pairs of nodes that are no loops and not forbidden; repeats may occur.

    Draw i takes two of the table's own nodes by hash. As many draws as pairs are made a round, at most so many rounds,
    until n remain; the rounds that are needed are guessed from the share that the rounds so far have left. nodes may be a
    table of numbered_nodes.
    """
    numbered = nodes if "idx" in nodes.columns else numbered_nodes(nodes)
    size = numbered.count()
    spark = nodes.sparkSession
    kept, made = None, 0
    while n and size and made < rounds:
        have = kept.count() if kept is not None else 0
        if have >= n:
            break
        share = max(have / (made * n), 1 / rounds) if made else 0.7
        more = min(rounds - made, max(1, math.ceil(1.1 * (n - have) / (share * n))))
        i = spark.range(made * n, (made + more) * n).withColumnRenamed("id", "i")
        drawn = i.select("i", *[F.floor(draw("i", F.lit(x), seed=seed) * size).cast("long").alias(x) for x in "ab"]).filter("a <> b")
        one, two = (numbered.select(F.col("node").alias(to), F.col("idx").alias(x)) for x, to in (("a", "n1"), ("b", "n2")))
        pairs = drawn.join(one, "a").join(two, "b").select("i", F.least("n1", "n2").alias("u"), F.greatest("n1", "n2").alias("v"))
        left = pairs.join(forbidden.select("u", "v"), ["u", "v"], "left_anti").select("i", "u", "v")
        kept = written(left if kept is None else kept.unionByName(left))
        made += more
    if kept is None:
        node = nodes.schema["node"].dataType.simpleString()
        return spark.createDataFrame([], f"i long, u {node}, v {node}")
    return ordered_index(kept, F.col("i")).filter(F.col("idx") < n).select("i", "u", "v")


def message_edges(edges: DataFrame, train: float = 0.8, val: float = 0.1, mp_share: float = 0.8) -> DataFrame:
    """The edges that link_samples lets pass messages, loops too."""
    span = cuts(edges, train, val)
    until = F.least(F.col("cut1"), F.col("a") + mp_share * (F.col("cut1") - F.col("a")))
    return edges.join(F.broadcast(span), how="cross").filter(F.col("ts") <= until).select(edges.columns)


def link_samples(edges: DataFrame, train: float = 0.8, val: float = 0.1, mp_share: float = 0.8, new_only: bool = True, ratio: float = 1.0, seed: int = 0, numbered: bool = False) -> DataFrame:
    """[split, u, v, label]: supervision, val and test pairs with as many sampled negatives (times ratio).

    Edges up to mp_share of the time from the first edge, loops too, to the end of training pass messages; later training
    edges are the train split's pairs. With
    new_only a split holds pairs that no earlier edge has (train: message passing; val and test: all of training; val and
    test are not held against each other). Negatives avoid all pairs of the table.
    numbered: + i, a negative's place among its split's from 0 in the order of draws, null for the others.
    """
    span = cuts(edges, train, val)
    at = F.when(F.col("ts") <= F.col("cut1"), "train").when(F.col("ts") <= F.col("cut2"), "val").otherwise("test")
    part = F.when(F.col("ts") <= F.least(F.col("cut1"), F.col("a") + mp_share * (F.col("cut1") - F.col("a"))), "messages").otherwise(at)
    pairs = written(edges.filter("src <> dst").join(F.broadcast(span), how="cross").select(part.alias("split"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())  # one row
    seen = pairs.filter("split = 'messages'").select("u", "v")
    before = pairs.filter("split IN ('messages', 'train')").select("u", "v").distinct()
    nodes = numbered_nodes(edges.select(F.explode(F.array("src", "dst")).alias("node")))
    taken = pairs.select("u", "v")
    out = None
    for i, name in enumerate(("train", "val", "test")):
        pos = pairs.filter(F.col("split") == name).select("split", "u", "v")
        if new_only:
            pos = pos.join(seen if name == "train" else before, ["u", "v"], "left_anti").select("split", "u", "v")
        pos = written(pos)
        neg = sample_negatives(nodes, taken, round(ratio * pos.count()), seed + i)
        place = {"i": F.lit(None).cast("long")} if numbered else {}
        neg = ordered_index(neg, F.col("i"), name="i") if numbered else neg.drop("i")
        both = pos.withColumns({"label": F.lit(1), **place}).unionByName(neg.select(F.lit(name).alias("split"), "u", "v", F.lit(0).alias("label"), *place))
        out = both if out is None else out.unionByName(both)
    return out


def fan_out(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """[src, dst]: at most k neighbours of each node, without replacement, by hash order. A row of the window is one neighbour."""
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy(draw("src", "dst", seed=seed), "dst")
    return edges.select("src", "dst").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("src", "dst")


def edge_growth(edges: DataFrame) -> DataFrame:
    """[day, n, share]: edges a day and the running share."""
    from pyspark.sql import Window

    days = edges.groupBy(F.floor(F.col("ts") / 86_400).alias("day")).agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n").alias("all"))
    return days.join(F.broadcast(total), how="cross").select("day", "n", (F.sum("n").over(Window.orderBy("day")) / F.col("all")).alias("share"))  # one row a day
