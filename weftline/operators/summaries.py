"""Summaries by class, histograms for reports, profile and label features, and table comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import ordered_index
from weftline.functions.scalars import ratio
from weftline.functions.segments import quantiles
from weftline.operators.metrics import correlation


def reindexed(edges: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges with src and dst as 0..n-1 in order of first appearance, [label, idx]); src stands before dst in a row."""
    pos = ordered_index(edges, *[F.col(c) for c in order], name="_pos")
    seen = pos.select(F.col("src").alias("label"), (F.col("_pos") * 2).alias("at")).union(pos.select("dst", F.col("_pos") * 2 + 1))
    first = ordered_index(seen.groupBy("label").agg(F.min("at").alias("at")), F.col("at")).select("label", "idx")
    a, b = first.select(F.col("label").alias("src"), F.col("idx").alias("s")), first.select(F.col("label").alias("dst"), F.col("idx").alias("d"))
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return pos.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *others), first


def label_counts(rows: DataFrame, label: str, labels: list) -> DataFrame:
    """[label, n] of all given labels in their order, those without rows too."""
    spine = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"place int, {label} {rows.schema[label].dataType.simpleString()}")
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return spine.join(n, label, "left").select(label, "place", F.coalesce("n", F.lit(0)).alias("n"))


def cascade_summary(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """[median_nodes, max_nodes, mean_depth], one row."""
    n = nodes.groupBy("item_id").agg(F.count("*").alias("n"))
    d = depths.groupBy("item_id").agg(F.max("depth").alias("depth"))
    return n.join(d, "item_id", "left").agg(F.max("n").alias("max_nodes"), F.avg(F.coalesce("depth", F.lit(0))).alias("mean_depth")).join(quantiles(n, [], "n", {"median_nodes": 0.5}), how="cross")  # one row each


def by_class(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """[label, feature, n, mean, median, sd, lo, hi]."""
    long = rows.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(label, "x.*")
    one = long.groupBy(label, "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).alias("l")
    middle = quantiles(long, [label, "feature"], "v", {"median": 0.5}).alias("r")
    return one.join(middle, F.col(f"l.{label}").eqNullSafe(F.col(f"r.{label}")) & (F.col("l.feature") == F.col("r.feature"))).select("l.*", "r.median")


def equal_width(values: Column, bins: int, lo: Column, hi: Column) -> Column:
    """Bin 0..bins-1 of a value in [lo, hi], the last closed; null outside."""
    at = F.floor((values - lo) * bins / F.nullif(hi - lo, F.lit(0)))
    return F.when((values >= lo) & (values <= hi), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int"))


def histogram(rows: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None, by: list[str] | None = None) -> DataFrame:
    """[by, bin, n, density]: equal-width bins over the given range, else over that of all rows; empty bins have no row."""
    ends = rows.agg((F.lit(lo) if lo is not None else F.min(value)).cast("double").alias("_lo"), (F.lit(hi) if hi is not None else F.max(value)).cast("double").alias("_hi"))
    x = rows.join(F.broadcast(ends), how="cross").select(*(by or []), equal_width(F.col(value).cast("double"), bins, F.col("_lo"), F.col("_hi")).alias("bin"), ((F.col("_hi") - F.col("_lo")) / bins).alias("width"))  # one row
    n = x.filter("bin IS NOT NULL").groupBy(*(by or []), "bin", "width").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)])))  # bins, not rows
    return n.select(*(by or []), "bin", "n", ratio(F.col("n"), total * F.col("width")).alias("density"))


def correlations(rows: DataFrame, features: list[str], y: Column) -> DataFrame:
    """[feature, r]: Pearson of each feature with y; null without variance."""
    long = rows.select(y.cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("y", "x.*")
    return long.groupBy("feature").agg(correlation("v", "y").alias("r"))


def profile_block(followers: Column, friends: Column, statuses: Column, listed: Column, verified: Column, description: Column) -> Column:
    """ARRAY of seven: log1p followers, log1p friends, followers over friends + 1, log1p statuses, log1p listed, verified, has a description."""
    n = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(c.cast("boolean").cast("double"), F.lit(0.0))
    return F.array(F.log1p(n(followers)), F.log1p(n(friends)), n(followers) / (n(friends) + 1), F.log1p(n(statuses)), F.log1p(n(listed)), flag(verified), flag(F.coalesce(description, F.lit("")) != ""))


def one_hot(rows: DataFrame, col: str, blank: str = "none") -> DataFrame:
    """rows + hot ARRAY<DOUBLE>: one place for each category in sorted order; null and blank are a category of their own."""
    value = F.coalesce(F.nullif(F.trim(F.col(col).cast("string")), F.lit("")), F.lit(blank))
    cats = rows.agg(F.sort_array(F.collect_set(value)).alias("_cats"))  # one row of all categories
    return rows.join(F.broadcast(cats), how="cross").withColumn("hot", F.transform("_cats", lambda x: (x == value).cast("double"))).drop("_cats")


def source_profiles(items: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """[item_id, x]: the profile of an item's node 0, zeros without one."""
    first = nodes.filter("node = 0").select("item_id", "profile")
    return items.select("item_id").join(first, "item_id", "left").select("item_id", F.coalesce("profile", F.array_repeat(F.lit(0.0), width)).alias("x"))


def veracity(misinformation: Column, true: Column) -> Column:
    """true, false or unverified from two annotations, either of which can be missing; null if they contradict or say nothing."""
    m, t = misinformation, true
    both = F.when((m == 0) & (t == 0), "unverified").when((m == 0) & (t == 1), "true").when((m == 1) & (t == 0), "false")
    return F.when(m.isNotNull() & t.isNotNull(), both).when(m.isNotNull(), F.when(m == 0, "unverified").otherwise("false"))


def binarised(label: Column, fake: list) -> Column:
    return label.isin(fake).cast("int")


def credit_block(credit: Column) -> Column:
    """log1p of the counts; they contain the item's own label, so no feature set takes them unless asked."""
    return F.transform(credit, lambda x: F.log1p(x.cast("double")))


def exploded_values(rows: DataFrame, col: str) -> DataFrame:
    """rows + value: the comma-separated parts of a column, trimmed, without empty ones."""
    return rows.withColumn("value", F.explode(F.split(F.coalesce(F.col(col).cast("string"), F.lit("")), ","))).withColumn("value", F.trim("value")).filter("value <> ''")


def expanded(users: DataFrame, vectors: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """users + vec, zeros for those without a vector; a vector of another width is an error."""
    zero = F.array_repeat(F.lit(0.0), width)
    checked = F.when(F.size(vec) == width, F.col(vec)).otherwise(F.raise_error(F.lit(f"vectors must have {width} elements")).cast(f"array<{vectors.schema[vec].dataType.elementType.simpleString()}>"))
    return users.join(vectors.select(key, checked.alias(vec)), key, "left").withColumn(vec, F.coalesce(vec, zero.cast(vectors.schema[vec].dataType)))


def key_nodes(features: DataFrame, k: int) -> DataFrame:
    """[node, h]: the k nodes of the highest time-weighted entropy, or of the last window's where none is above 0 (ties: smaller node)."""
    some = features.agg(F.max("lne_tw").alias("_top"))
    h = F.when(F.coalesce(F.col("_top"), F.lit(0.0)) > 0, F.col("lne_tw")).otherwise(F.col("lne_last"))
    return features.join(F.broadcast(some), how="cross").select("node", h.alias("h")).orderBy(F.desc("h"), "node").limit(k)  # one row


def hubs_and_keys(degrees: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """[node]: the k highest degrees (ties: smaller node) and the key nodes."""
    return degrees.orderBy(F.desc("deg"), "node").limit(k).select("node").union(keys.select("node")).distinct()


def first_posts(posts: DataFrame, user: str, order: list[str], n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    return posts.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")


def seed_spread(runs: DataFrame) -> DataFrame:
    """[method, spread, fold_sd]: highest less lowest seed mean, beside the mean over seeds of the SD over folds."""
    by = runs.groupBy("method", "seed").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return by.groupBy("method").agg((F.max("m") - F.min("m")).alias("spread"), F.avg("s").alias("fold_sd"))


def against_published(ours: DataFrame, published: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """[keys, obtained, expected, difference, matches]: every published row, with what was obtained or null."""
    x = published.join(ours, keys, "left")
    return x.select(*keys, "obtained", "expected", (F.col("obtained") - F.col("expected")).alias("difference"), F.coalesce(F.abs(F.col("obtained") - F.col("expected")) <= tolerance, F.lit(False)).alias("matches"))


def concatenated(tables: list[tuple[str, DataFrame]], names: dict[str, str]) -> DataFrame:
    """The tables under one another with their name, mapped to its long form; missing columns are null."""
    from functools import reduce

    named = [df.withColumn("source", F.lit(names.get(name, name))) for name, df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
