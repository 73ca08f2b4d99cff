"""Meta-analysis of published results: nested method tables in, relational summaries out.

methods: [method_id, ref, year, gnn ARRAY<STRING>, graph, features ARRAY<STRING>, setting, results ARRAY<STRUCT<dataset, metric, value>>].
datasets: [name, labels ARRAY<STRING>, size]. taxonomy: [label, parent, place INT, refs ARRAY<STRING>].
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import written
from weftline.functions.scalars import ratio


def wide_methods(methods: DataFrame) -> DataFrame:
    """One row a method with its lists joined to text; performance is `dataset metric: value` to three places."""
    said = F.transform("results", lambda r: F.concat(r["dataset"], F.lit(" "), r["metric"], F.lit(": "), F.format_string("%.3f", r["value"].cast("double"))))
    return methods.select("method_id", "ref", "year", F.array_join("gnn", ", ").alias("gnn"), "graph", F.array_join("features", ", ").alias("features"), "setting", F.array_join(F.transform("results", lambda r: r["dataset"]), ", ").alias("datasets"), F.array_join(said, "; ").alias("performance"))


def wide_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.select(F.col("name").alias("dataset"), F.size("labels").alias("n_labels"), F.array_join("labels", ", ").alias("labels"), "size")


def long_results(methods: DataFrame) -> DataFrame:
    """One row a method, dataset and metric."""
    return methods.select("method_id", "ref", "year", "gnn", "graph", "setting", F.inline("results"))


def mentions(methods: DataFrame, column: str) -> DataFrame:
    """[value, n, share]: how often a list field names each value, and its share of all methods."""
    total = methods.agg(F.count("*").alias("all"))
    n = methods.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total), how="cross").select("value", "n", ratio(F.col("n"), F.col("all")).alias("share"))  # one row


def year_trend(methods: DataFrame) -> DataFrame:
    """[year, n, so_far]."""
    n = methods.groupBy("year").agg(F.count("*").alias("n"))
    return n.withColumn("so_far", F.sum("n").over(Window.orderBy("year")))  # one row a year


def _listed(counts: DataFrame) -> DataFrame:
    """[said]: `value=n` of all rows, the most frequent first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n")))
    return counts.agg(F.array_join(F.transform(order, lambda r: F.concat(r["value"], F.lit("="), r["n"])), ", ").alias("said"))  # a row a category


def verify_claims(methods: DataFrame, datasets: DataFrame, first_year: int, leaders: list[str], majority_graph: str, main_feature: str, rare: list[str], setting: str, metric: str) -> DataFrame:
    """[claim, supported, evidence]: six claims about the literature, each held against the table.

    The first year; the two most mentioned architectures; a graph kind in over half the methods; a feature in over half,
    and each of the rare ones in under half of that; a setting in over half; over half of the multi-class results under 0.5.
    """
    n = methods.agg(F.count("*").alias("all"))
    one = lambda df, claim, ok, said: df.select(F.lit(claim).alias("claim"), ok.alias("supported"), said.alias("evidence"))
    share = lambda col: F.concat(F.format_string("%d/%d", F.col(col), F.col("all")), F.lit("; "), F.col("said"))
    years = methods.agg(F.min("year").alias("y"))
    first = methods.join(years, how="cross").filter("year = y").groupBy("y").agg(F.array_join(F.sort_array(F.collect_set("ref")), ", ").alias("refs"))  # the first year's methods
    gnn = written(mentions(methods, "gnn"))
    top = gnn.orderBy(F.desc("n"), "value").limit(2).agg(F.sort_array(F.collect_list("value")).alias("top"))
    by = lambda col: methods.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    of = lambda counts, value: counts.agg(F.coalesce(F.sum(F.when(F.col("value") == value, F.col("n"))), F.lit(0)).alias("k"))
    feats = written(mentions(methods, "features"))
    rare_most = feats.agg(F.coalesce(F.max(F.when(F.col("value").isin(rare), F.col("n"))), F.lit(0)).alias("r"))
    many = datasets.filter(F.size("labels") > 2).select(F.col("name").alias("dataset"))
    mc = long_results(methods).filter(F.col("metric") == metric).join(many, "dataset", "left_semi").agg(F.count("*").alias("m"), F.count_if(F.col("value") < 0.5).alias("b"), F.median("value").alias("med"))
    graphs, settings = written(by("graph")), written(by("setting"))
    parts = [
        one(first, "first_year", F.col("y") == first_year, F.concat(F.col("y").cast("string"), F.lit(": "), "refs")),
        one(top.join(_listed(gnn), how="cross"), "leaders", F.col("top") == F.array(*[F.lit(x) for x in sorted(leaders)]), F.col("said")),
        one(of(graphs, majority_graph).join(n, how="cross").join(_listed(graphs), how="cross"), "majority_graph", F.col("k") > F.col("all") / 2, share("k")),
        one(of(feats, main_feature).join(n, how="cross").join(rare_most, how="cross").join(_listed(feats), how="cross"), "main_feature", (F.col("k") > F.col("all") / 2) & (F.col("r") < F.col("k") / 2), share("k")),
        one(of(settings, setting).join(n, how="cross").join(_listed(settings), how="cross"), "setting", F.col("k") > F.col("all") / 2, share("k")),
        one(mc, "multiclass_low", F.col("b") > F.col("m") / 2, F.concat(F.format_string("%d of %d below 0.5; median %.3f", F.col("b"), F.col("m"), F.col("med").cast("double")))),
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_sizes(datasets: DataFrame, counts: DataFrame) -> DataFrame:
    """[dataset, printed, found, matches, delta]: printed sizes against what was found; null where nothing was."""
    x = datasets.select(F.col("name").alias("dataset"), F.col("size").alias("printed")).join(counts.select(F.col("name").alias("dataset"), F.col("n").alias("found")), "dataset", "left")
    return x.select("dataset", "printed", "found", (F.col("found") == F.col("printed")).alias("matches"), (F.col("found") - F.col("printed")).alias("delta"))


def ranges(results: DataFrame, metric: str, min_n: int) -> DataFrame:
    """[dataset, n, lo, hi, spread, median, place]: of datasets with min_n results, in the order of their medians."""
    r = results.filter(F.col("metric") == metric).groupBy("dataset").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.median("value").alias("median")).filter(F.col("n") >= min_n)
    return r.withColumn("spread", F.col("hi") - F.col("lo")).withColumn("place", F.row_number().over(Window.orderBy("median", "dataset")))  # one row a dataset


def coverage(results: DataFrame, metric: str) -> DataFrame:
    """[dataset, family, mean, n, families]: by dataset and first-listed family, with the number of families that the dataset has."""
    r = results.filter(F.col("metric") == metric).groupBy("dataset", F.element_at("gnn", 1).alias("family")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return r.withColumn("families", F.count("*").over(Window.partitionBy("dataset")))


def coverage_grid(results: DataFrame, metric: str, families: list[str]) -> DataFrame:
    """[dataset, a column a family]: the same as a pivot, null where there is no evidence."""
    return results.filter(F.col("metric") == metric).withColumn("family", F.element_at("gnn", 1)).groupBy("dataset").pivot("family", families).agg(F.avg("value"))


def against_range(ours: DataFrame, results: DataFrame, metric: str) -> DataFrame:
    """[dataset, best, method, lo, hi, inside]: our best row of each dataset (ties: smaller method) and whether it lies in the published range."""
    best = ours.groupBy("dataset").agg(F.max_by(F.struct("value", "method"), F.struct(F.col("value"), -F.col("rank"))).alias("b")) if "rank" in ours.columns else _best(ours)
    pub = results.filter(F.col("metric") == metric).groupBy("dataset").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return best.join(pub, "dataset", "left").select("dataset", F.col("b.value").alias("best"), F.col("b.method").alias("method"), "lo", "hi", F.col("b.value").between(F.col("lo"), F.col("hi")).alias("inside"))


def _best(ours: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("value"), "method"))
    return ours.withColumn("_r", r).filter("_r = 1").select("dataset", F.struct("value", "method").alias("b"))


def below_baseline(results: DataFrame, metric: str, baseline: Column) -> DataFrame:
    """[method_id, dataset, value, gap]: results under the baseline and how far."""
    return results.filter((F.col("metric") == metric) & (F.col("value") < baseline)).select("method_id", "dataset", "value", (baseline - F.col("value")).alias("gap"))


def taxonomy_paths(nodes: DataFrame) -> DataFrame:
    """[label, depth, path, order]: each node's labels from its root down; order sorts the tree as it is printed.

    Each round joins a node's path to that of its pointer, which doubles it, so rounds grow with the logarithm of the depth.
    Nodes on a cycle, below one, or below an unknown label have no row. Labels are unique.
    """
    place = F.format_string("%04d", F.col("place"))
    state = live = written(nodes.select("label", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col("label").alias("path"), place.alias("order")))
    done: list[DataFrame] = []
    while not (ended := live.filter("up IS NULL")).isEmpty():
        done.append(ended)
        ahead = state.select(F.col("label").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("path").alias("p"), F.col("order").alias("o"))
        live = written(live.join(ahead, "up").select("label", F.col("next").alias("up"), (F.col("depth") + F.col("d") + 1).alias("depth"), F.concat("p", F.lit(" > "), "path").alias("path"), F.concat("o", F.lit("."), "order").alias("order")))
        state = reduce(DataFrame.unionByName, [*done, live])
    return reduce(DataFrame.unionByName, done or [live]).select("label", "depth", "path", "order")


def described(nodes: DataFrame) -> DataFrame:
    """[order, line, leaf, refs]: the tree as indented lines, whether a node is a leaf, and its number of references."""
    inner = nodes.select(F.col("parent").alias("label")).filter("label IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    x = taxonomy_paths(nodes).join(nodes.select("label", F.size("refs").alias("refs")), "label").join(inner, "label", "left")
    return x.select("order", F.concat(F.repeat(F.lit("    "), F.col("depth")), "label").alias("line"), F.col("inner").isNull().alias("leaf"), "refs")


def spreads(runs: DataFrame, a: str, b: str) -> DataFrame:
    """[dataset, a_spread, b_spread, a_wider]: highest less lowest mean over the values of a, and over those of b, beside each other."""
    def one(by: str) -> DataFrame:
        m = runs.groupBy("dataset", by).agg(F.avg("value").alias("m"))
        return m.groupBy("dataset").agg((F.max("m") - F.min("m")).alias(f"{by}_spread"))

    x = one(a).join(one(b), "dataset", "full")
    return x.withColumn("a_wider", F.col(f"{a}_spread") > F.col(f"{b}_spread"))
