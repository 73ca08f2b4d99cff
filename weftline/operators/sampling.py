"""Draws that any engine can repeat: walks, perturbed snapshots, rings, caps, samples; and splits that come with the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import counted, ordered_index, written
from weftline.functions.scalars import draw, permutation_keys, permuted
from weftline.functions.segments import quantiles, stepped, within_quotas


def lowest_draws(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows, those with the lowest draws (ties: smaller key); numbered by range, so no task sorts all."""
    named = rows.withColumn("_draw", draw(key, seed=seed))
    return ordered_index(named, F.col("_draw"), F.col(key)).filter(F.col("idx") < n).drop("idx", "_draw")


#: Draws that a biased step makes before all neighbours are weighed.
MOST_TRIES = 252


def numbered_links(edges: DataFrame) -> DataFrame:
    """[node, k, dst, deg, dst_deg]: a node's different neighbours numbered from 0 in order, and both ends' numbers of neighbours."""
    out = stepped(edges.select("src", "dst").distinct(), ["src"], ["dst"], number="k")
    deg = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("deg"))
    near, far = deg.withColumnRenamed("src", "node"), deg.select(F.col("src").alias("dst"), F.col("deg").alias("dst_deg"))
    linked = out.withColumnRenamed("src", "node").join(near, "node").join(far, "dst", "left").select("node", "k", "dst", "deg", "dst_deg")
    return linked.na.fill(0, ["dst_deg"])


def random_walks(edges: DataFrame, num_walks: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0, tries: int = 4) -> DataFrame:
    """[walk, start, step, node]: num_walks walks from every node that sends; a dead end ends a walk.

    A step's draw takes a neighbour by its number. With other p and q a neighbour weighs 1/p if it is the last node, 1 if it
    is a neighbour of that, else 1/q, and the draw is taken with its weight over the largest: rejected walks draw again, in
    batches of `tries`, twice as many each time; walks that MOST_TRIES draws have not moved (where p or q is extreme) hold a
    race of all their node's neighbours, exponential by weight, as one aggregate. A walk knows its node's number of neighbours, so no node's links are
    gathered: a step is a join on (node, number) and one on (last node, proposal), whose work is linear in the walks and
    which spread a hub over tasks. All walks go forward together, written each step so that lineage stays short.
    """
    links = written(numbered_links(edges))
    pairs = links.select(F.col("node").alias("last"), F.col("dst").alias("next"), F.lit(True).alias("beside"))
    starts = links.filter("k = 0").select(F.col("node").alias("start"), "deg").withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
    at = written(starts.select("walk", "start", F.lit(None).cast(edges.schema["src"].dataType).alias("last"), F.col("start").alias("node"), "deg"))
    steps = [at.select("walk", "start", F.lit(0).alias("step"), "node")]
    uniform, top = p == 1 and q == 1, max(1.0 / p, 1.0, 1.0 / q)

    def proposed(walks: DataFrame, *named) -> DataFrame:
        k = F.floor(draw("start", "walk", *named, seed=seed) * F.col("deg")).cast("long")
        met = walks.filter("deg > 0").withColumn("k", k).drop("deg").join(links.select("node", "k", F.col("dst").alias("next"), F.col("dst_deg").alias("next_deg")), ["node", "k"])
        return met.drop("k")

    for i in range(1, length):
        if uniform or i == 1:
            moved = proposed(at, F.lit(i))
        else:
            moved, left, made, n = None, at.filter("deg > 0"), 0, tries
            weight = F.when(F.col("next") == F.col("last"), 1.0 / p).when(F.col("beside"), 1.0).otherwise(1.0 / q)
            while moved is None or (made < MOST_TRIES and not left.isEmpty()):
                tried = left.withColumn("try", F.explode(F.sequence(F.lit(made), F.lit(made + n - 1))))
                drawn = proposed(tried, F.lit(i), "try").join(pairs, ["last", "next"], "left")
                taken = drawn.filter(draw("start", "walk", F.lit(i), "try", F.lit("w"), seed=seed) < weight / top)
                first = F.min_by(F.struct("last", "node", "next", "next_deg"), "try").alias("x")  # of n tries
                got = written(taken.groupBy("walk", "start").agg(first).select("walk", "start", "x.*"))
                moved = got if moved is None else moved.unionByName(got)
                left = written(left.join(got.select("walk", "start"), ["walk", "start"], "left_anti"))
                made, n = made + n, 2 * n
            rest = left.drop("deg").join(links.select("node", F.col("dst").alias("next"), F.col("dst_deg").alias("next_deg")), "node").join(pairs, ["last", "next"], "left")
            race = -F.ln(1 - draw("start", "walk", F.lit(i), "next", F.lit("e"), seed=seed)) / weight
            moved = moved.unionByName(rest.groupBy("walk", "start").agg(F.min_by(F.struct("last", "node", "next", "next_deg"), F.struct(race, "next")).alias("x")).select("walk", "start", "x.*"))
        at = written(moved.select("walk", "start", F.col("node").alias("last"), F.col("next").alias("node"), F.col("next_deg").alias("deg")))
        steps.append(at.select("walk", "start", F.lit(i).alias("step"), "node"))
    return reduce(DataFrame.unionByName, steps)


def augment(snaps: DataFrame, add: float = 0.05, delete: float = 0.02, seed: int = 0) -> DataFrame:
    """[w, u, v]: each window's snapshot perturbed.

    Of a window's edges those of the lowest draws go; of all nodes the first ones of a permutation that the window chooses go
    with their edges; quotas are rounded half to even. Then new nodes come, numbered after the largest, and edges between
    two draws over old and new nodes; a draw of a node that went is drawn over, in twice as many tries as edges; loops are
    left out. Isolated nodes have no row. Work is the edges, the victims and the tries, dealt over tasks: no window is crossed
    with all nodes.
    """
    snaps = written(snaps)
    nodes = written(ordered_index(snaps.select(F.col("u").alias("node")).union(snaps.select("v")).distinct(), F.col("node")))
    n, top = nodes.agg(F.count("*"), F.max("node")).first()
    gone_n, new_n = round(delete * n), round(add * n)
    sizes = written(snaps.groupBy("w").agg(F.count("*").alias("m")))
    edges = within_quotas(snaps.select("w", F.struct("u", "v").alias("e")), ["w"], draw("w", "e.u", "e.v", seed=seed), "e", {"gone": lambda m: F.bround(m * delete)})
    left = edges.filter(~F.col("gone")).select("w", "e.u", "e.v")
    places = counted(sizes.select("w", permutation_keys(F.lit(n), "w", seed=seed + 1).alias("keys")), F.lit(gone_n), "i")
    victims = written(places.select("w", permuted(F.col("i"), F.lit(n), "w", seed=seed + 1, keys=F.col("keys")).alias("idx")).join(nodes, "idx").select("w", "node", "idx"))
    for end in ("u", "v"):
        left = left.join(victims.select("w", F.col("node").alias(end)), ["w", end], "left_anti")
    tries = counted(sizes.select("w", F.bround(F.col("m") * add).cast("int").alias("k")), 2 * F.col("k"), "i")
    pool = n + new_n
    drawn = tries.select("w", "k", "i", *[F.floor(draw("w", "i", F.lit(x), seed=seed + 2) * pool).cast("long").alias(x) for x in "ab"])
    for end in "ab":
        drawn = drawn.join(victims.select("w", F.col("idx").alias(end)), ["w", end], "left_anti")
    first = stepped(drawn, ["w"], ["i"], number="r").filter("r < k AND a <> b")
    named = lambda end: nodes.select(F.col("idx").alias(end), F.col("node").alias(f"n{end}"))
    full = first.join(named("a"), "a", "left").join(named("b"), "b", "left")
    node = lambda end: F.coalesce(F.col(f"n{end}"), F.col(end) - n + top + 1)
    added = full.select("w", F.least(node("a"), node("b")).alias("u"), F.greatest(node("a"), node("b")).alias("v"))
    return left.select("w", "u", "v").unionByName(added).distinct()


def labelled_split(rows: DataFrame, labels: DataFrame, key: str, split: str = "split") -> DataFrame:
    """rows with a label, by the split that the data bring; no row at all if train, val or test would be empty."""
    kept = written(rows.join(labels, key))
    parts = {r[split] for r in kept.select(split).distinct().filter(F.col(split).isin("train", "val", "test")).collect()}
    return kept if len(parts) == 3 else kept.limit(0)


def split_drift(rows: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """[feature, auc, train_median, test_median]: how well each feature alone tells test from train rows."""
    from weftline.operators.metrics import auc

    both = rows.filter(F.col(split).isin("train", "test"))
    long = both.select(split, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])).alias("x")).select(split, "x.*")
    area = auc(long.withColumn("label", (F.col(split) == "test").cast("int")), ["feature"])
    middle = lambda part: quantiles(long.filter(F.col(split) == part), ["feature"], "score", {f"{part}_median": 0.5})
    return area.join(middle("train"), "feature", "left").join(middle("test"), "feature", "left")


def subsampled(rows: DataFrame, key: str, order: str, sizes: list[int], repeats: int, seed: int) -> DataFrame:
    """rows + n, rep: for each size and repeat, n rows of every key that has so many, by draws without replacement."""
    sized = rows.withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    grid = sized.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = F.row_number().over(Window.partitionBy(key, "rep").orderBy(draw(order, "rep", seed=seed), order))
    ranked = grid.withColumn("_r", r).withColumn("n", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return ranked.filter((F.col("_r") <= F.col("n")) & (F.col("_all") >= F.col("n"))).drop("_r", "_all")
