"""Building graphs: similarity, cascades as propagation and post-user graphs, merging, restriction, unrolling.

Cascade nodes are [item_id, node, uid, delay_min, profile ARRAY<DOUBLE>], cascade edges [item_id, parent, child], item
features [item_id, x ARRAY<DOUBLE>]. Built graphs are nodes [graph_id, node, x, node_type] and edges [graph_id, src, dst].
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import written
from weftline.functions.scalars import ratio
from weftline.functions.segments import quantiles
from weftline.operators.similar import nearby_pairs, nearest_pairs, similar_pairs, unit_vectors
from weftline.operators.temporal import to_undirected

#: Rows of small numbers that a task holds apart: Spark joins partitions up to a size in bytes, which is millions of packed rows.
EDGE_ROWS = 250_000


def threshold_graph(vectors: DataFrame, threshold: float = 0.8, max_degree: int | None = 64, recall: float | None = None) -> DataFrame:
    """[src, dst] both ways between vectors of a cosine of at least threshold; each keeps its max_degree most similar (ties: smaller id).

    With a recall below 1 pairs at the threshold are found with that probability, closer ones more surely, in time near
    linear in the vectors; that needs a max_degree.
    """
    unit = unit_vectors(vectors)
    if recall is not None:
        if max_degree is None:
            raise ValueError("an approximate graph needs a max_degree")
        return to_undirected(nearby_pairs(unit, max_degree, threshold, recall))
    pairs = similar_pairs(unit, threshold, max_degree)
    return to_undirected(most_similar(pairs, max_degree)) if max_degree is not None else pairs.select("src", "dst")


def most_similar(pairs: DataFrame, k: int) -> DataFrame:
    """[src, dst, sim]: each src's k highest sim, ties to the smaller dst."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return pairs.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r")


def knn_graph(vectors: DataFrame, k: int = 4, undirected: bool = True, recall: float | None = None, cosine: float = 0.8) -> DataFrame:
    """[src, dst]: each vector's k most similar by cosine send to it; undirected adds the way back.

    With a recall, approximate: a neighbour of that cosine is found with that probability.
    """
    unit = unit_vectors(vectors)
    near = (nearest_pairs(unit, k) if recall is None else nearby_pairs(unit, k, cosine, recall, threshold=-2.0)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return to_undirected(near) if undirected else near


def propagation_graph(nodes: DataFrame, edges: DataFrame, features: DataFrame, root_edges: bool = True, undirected: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph an item, from its repost tree.

    A node has the item's features, its own profile (zeros if missing), log(1 + delay) with unknown or negative delays as
    0, and its number over the item's nodes. An item without a cascade is one node without edges. root_edges joins the root to all others.
    """
    size = nodes.groupBy("item_id").agg(F.count("*").alias("n"))
    own = nodes.join(size, "item_id")
    delay = F.when(F.isnan("delay_min") | (F.abs("delay_min") == float("inf")), None).otherwise(F.col("delay_min"))
    place = F.array(F.log1p(F.greatest(F.coalesce(delay, F.lit(0.0)), F.lit(0.0))), F.col("node") / F.col("n"))
    width, rows = nodes.agg(F.coalesce(F.max(F.size("profile")), F.lit(0)), F.count("*")).first()
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    full = features.join(own.select("item_id", "node", F.concat(F.coalesce("profile", zeros(max(width, 0))), place).alias("p")), "item_id", "left")
    alone = zeros(max(width, 0) + 2)
    made = full.select(F.col("item_id").alias("graph_id"), F.coalesce("node", F.lit(0)).alias("node"), F.concat("x", F.coalesce("p", alone)).alias("x"), F.lit(0).alias("node_type"))
    e = edges.select(F.col("item_id").alias("graph_id"), F.col("parent").alias("src"), F.col("child").alias("dst"))
    if root_edges:
        e = e.unionByName(nodes.filter("node > 0").select(F.col("item_id").alias("graph_id"), F.lit(0).alias("src"), F.col("node").alias("dst")))
    return made, both_ways(e, 2 * rows) if undirected else e


def both_ways(edges: DataFrame, rows: int) -> DataFrame:
    """[graph_id, src, dst] in both directions, without loops and repeats, of about so many rows."""
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // EDGE_ROWS))
    once = edges.filter("src <> dst").select("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    once = once.repartition(parts, "graph_id", "lo", "hi").distinct()
    return once.select("graph_id", F.explode(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))).alias("e")).select("graph_id", "e.*")


def heterogeneous_graph(nodes: DataFrame, edges: DataFrame, features: DataFrame, root_edges: bool = True, undirected: bool = True) -> tuple[DataFrame, DataFrame]:
    """The propagation graph with one more node (node_type 1) for each user of an item, in the order of their ids.

    A user node has the mean of the user's posts and is joined to each of them both ways. Users are numbered within their
    item after its posts.
    """
    posts, tree = propagation_graph(nodes, edges, features, root_edges, undirected)
    posts = written(posts)
    size = nodes.groupBy(F.col("item_id").alias("graph_id")).agg(F.count("*").alias("n"))
    users = nodes.select(F.col("item_id").alias("graph_id"), "uid").distinct()
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("uid")) - 1  # the users of one item
    numbered = written(users.withColumn("r", rank).join(size, "graph_id").select("graph_id", "uid", (F.col("n") + F.col("r")).cast("int").alias("user")))
    wrote = written(nodes.select(F.col("item_id").alias("graph_id"), "node", "uid").join(numbered, ["graph_id", "uid"]).select("graph_id", "node", "user"))
    parts = wrote.join(posts, ["graph_id", "node"]).select("graph_id", "user", F.posexplode("x").alias("pos", "v")).groupBy("graph_id", "user", "pos").agg(F.avg("v").alias("v"))
    means = parts.groupBy("graph_id", "user").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x"))
    authored = wrote.select("graph_id", F.col("user").alias("src"), F.col("node").alias("dst"))
    return posts.unionByName(means.select("graph_id", F.col("user").alias("node"), "x", F.lit(1).alias("node_type"))), tree.unionByName(both_ways(authored, wrote.count()))


KINDS = ("similarity", "nearest", "attribute", "propagation", "heterogeneous")


def build(kind: str, **inputs):
    """The named kind of graph from its inputs (see each builder); an unknown name or missing input is an error."""
    from weftline.operators.graph import attribute_pairs

    builders = {"similarity": threshold_graph, "nearest": knn_graph, "attribute": attribute_pairs, "propagation": propagation_graph, "heterogeneous": heterogeneous_graph}
    if kind not in builders:
        raise ValueError(f"unknown kind of graph {kind!r}; one of {', '.join(KINDS)}")
    return builders[kind](**inputs)


def collate(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One node and one edge table of many: the graph's place in the list becomes part of the key, so no edge crosses."""
    named = lambda i, df: df.withColumn("part", F.lit(i))
    return tuple(reduce(DataFrame.unionByName, [named(i, g[side]) for i, g in enumerate(graphs)]) for side in (0, 1))


def restrict(edges: DataFrame, features: DataFrame, scope: str = "labelled") -> DataFrame:
    """edges, all or (labelled) those whose both ends have any feature other than 0."""
    if scope == "all":
        return edges
    if scope != "labelled":
        raise ValueError(f"unknown scope {scope!r}")
    has = features.filter(F.exists("x", lambda v: v != 0)).select("node")
    return within(edges, has)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends are in nodes [node]: the induced subgraph."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(edges.columns)


def unrolled(edges: DataFrame, roots: DataFrame, layers: int) -> DataFrame:
    """[root, level, node, n]: how often each node stands in each level of the root's computation tree.

    Level 0 is the root; each next level holds, for every node of the one before, the node and its neighbours. Equal nodes
    of a level are one row with a count, so a level never has more rows than the graph has nodes.
    """
    with_self = written(edges.select("src", "dst").distinct())
    level = written(roots.select(F.col("node").alias("root"), "node", F.lit(1).cast("long").alias("n")))
    out = level.withColumn("level", F.lit(0))
    for i in range(1, layers):
        near = level.join(with_self, level["node"] == with_self["src"]).select("root", F.col("dst").alias("node"), "n")
        level = written(level.unionByName(near).groupBy("root", "node").agg(F.sum("n").alias("n")))
        out = out.unionByName(level.withColumn("level", F.lit(i)))
    return out.select("root", "level", "node", "n")


def degree_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[graph_id, node, d]: receivers' degrees, 0 for those that receive nothing."""
    d = edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count("*").alias("d"))
    return nodes.select("graph_id", "node").join(d, ["graph_id", "node"], "left").na.fill(0, ["d"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[graphs, nodes, edges, mean_degree, max_degree, isolated, mean_nodes, median_nodes, max_nodes, mean_edges, edgeless], one row."""
    d = degree_table(nodes, edges).groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("d").alias("e"), F.max("d").alias("m"), F.count_if(F.col("d") == 0).alias("i"))
    d = written(d)
    return d.agg(
        F.count("*").alias("graphs"), F.sum("n").alias("nodes"), F.sum("e").alias("edges"), ratio(F.sum("e"), F.sum("n")).alias("mean_degree"), F.max("m").alias("max_degree"), ratio(F.sum("i"), F.sum("n")).alias("isolated"),
        F.avg("n").alias("mean_nodes"), F.max("n").alias("max_nodes"), F.avg("e").alias("mean_edges"), F.avg((F.col("e") == 0).cast("double")).alias("edgeless"),
    ).join(quantiles(d, [], "n", {"median_nodes": 0.5}), how="cross")  # one row each


def degeneracy(edges: DataFrame, features: DataFrame, labelled: DataFrame) -> DataFrame:
    """[edges, featured, share, isolated, median_degree, zero_means, median_featured]: how much a graph can say about labelled users.

    featured: edges with features at either end; isolated: labelled nodes without such an edge; degrees are of labelled nodes
    over all edges; zero_means: share of labelled nodes whose neighbours have no feature; median_featured: median share of
    featured neighbours among labelled nodes with any.
    """
    e = written(edges.select("src", "dst"))
    has = written(features.filter(F.exists("x", lambda v: v != 0)).select("node"))
    full = within(e, has)
    near = e.join(has.select(F.col("node").alias("src"), F.lit(1).alias("f")), "src", "left").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("d"), F.count("f").alias("k"))
    at = labelled.select("node").join(near, "node", "left").na.fill(0, ["d", "k"])
    joined = labelled.select("node").join(full.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").agg(F.count("*").alias("isolated"))
    at = written(at)
    middle = quantiles(at, [], "d", {"median_degree": 0.5}).join(quantiles(at.filter("d > 0").withColumn("share", F.col("k") / F.col("d")), [], "share", {"median_featured": 0.5}), how="cross")  # one row each
    by = at.agg(F.avg((F.col("k") == 0).cast("double")).alias("zero_means")).join(middle, how="cross")
    return e.agg(F.count("*").alias("edges")).join(full.agg(F.count("*").alias("featured")), how="cross").withColumn("share", ratio(F.col("featured"), F.col("edges"))).join(joined, how="cross").join(by, how="cross")  # one row each
