"""Message passing with given weights, beyond the single-step forms in graph.py.

Nodes are [node, x ARRAY<DOUBLE>], edges [src, dst]: src sends to dst. Weight matrices are lists of rows, one an input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import dot, draw
from weftline.functions.segments import within_quotas
from weftline.operators.graph import _mean, affine, effective_input, scatter, scatter_softmax

Matrix = list[list[float]]


def with_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[src, dst] and a loop at every node."""
    return edges.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))


def mean_weights(edges: DataFrame) -> DataFrame:
    """[src, dst, w]: each receiver's edges weigh one over its degree, so rows sum to 1."""
    d = edges.groupBy("dst").agg(F.count("*").alias("d"))
    return edges.join(d, "dst").select("src", "dst", (1.0 / F.col("d")).alias("w"))


def weighted_sum(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """[node, x]: the sum of w * x over [src, dst, w]; zeros where nothing arrives."""
    sent = weights.join(nodes, weights["src"] == nodes["node"]).select(F.col("dst").alias("to"), "x", "w")
    got = _mean(sent.select(F.col("to").alias("t"), "x", "w"), ["t"], F.col("w"), True).withColumnRenamed("x", "got")
    return nodes.join(got, nodes["node"] == got["t"], "left").select("node", F.coalesce("got", F.transform("x", lambda _: F.lit(0.0))).alias("x"))


def row_normalised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[node, x]: the mean over the neighbours and the node itself."""
    return weighted_sum(nodes, mean_weights(with_loops(nodes, edges)))


def unit_rows(nodes: DataFrame) -> DataFrame:
    """[node, x] over its length; a zero vector stays."""
    n = F.sqrt(dot(F.col("x"), F.col("x")))
    return nodes.select("node", F.transform("x", lambda v: F.coalesce(F.try_divide(v, n), F.lit(0.0))).alias("x"))


def sage(nodes: DataFrame, edges: DataFrame, weights: Matrix, aggregator: str = "mean", pool: Matrix | None = None, reduce: str = "mean", bias: list[float] | None = None, normalise: bool = False) -> DataFrame:
    """One step on [own, aggregate]: mean, sum or max of the neighbours, or (pool) mean or max of relu(x pool)."""
    if aggregator not in ("mean", "sum", "max", "pool"):
        raise ValueError(f"unknown aggregator {aggregator!r}")
    sent = affine(nodes, pool, relu=True) if aggregator == "pool" else nodes
    agg = scatter(sent, edges, reduce if aggregator == "pool" else aggregator).select("node", F.col("x").alias("m"))
    out = affine(nodes.join(agg, "node").select("node", F.concat("x", "m").alias("x")), weights, bias)
    return unit_rows(out) if normalise else out


def gin(nodes: DataFrame, edges: DataFrame, eps: float, first: Matrix, second: Matrix, first_bias: list[float] | None = None, second_bias: list[float] | None = None) -> DataFrame:
    """relu(((1 + eps) x + sum of neighbours) first) second."""
    total = scatter(nodes, edges, "sum").select("node", F.col("x").alias("s"))
    h = nodes.join(total, "node").select("node", F.zip_with("x", "s", lambda a, b: a * (1 + eps) + b).alias("x"))
    return affine(affine(h, first, first_bias, relu=True), second, second_bias)


def attention(nodes: DataFrame, edges: DataFrame, heads: list[dict], form: str = "gat", softmax: bool = True, concat: bool = True, slope: float = 0.2, bias: list[float] | None = None) -> DataFrame:
    """[node, x] with loops at all nodes. A head has send (matrix W) and, for gat, from and to (vectors on W x of sender and
    receiver); for gatv2, receive (the receiver's matrix) and att (a vector on the leaky relu of the sum).

    gat: leaky(to . Wx_v + from . Wx_u); gatv2: att . leaky(R x_v + W x_u). Shares by softmax over a receiver, or the
    sigmoid of each score. Heads are concatenated or averaged.
    """
    leaky = lambda z: F.when(z > 0, z).otherwise(z * slope)
    fixed = lambda v: F.array(*[F.lit(float(x)) for x in v])
    e = with_loops(nodes, edges)
    out = None
    for i, head in enumerate(heads):
        h = affine(nodes, head["send"])
        if form == "gat":
            s = h.select(F.col("node").alias("src"), F.col("x").alias("h"), dot(F.col("x"), fixed(head["from"])).alias("s"))
            r = h.select(F.col("node").alias("dst"), dot(F.col("x"), fixed(head["to"])).alias("r"))
            scored = e.join(s, "src").join(r, "dst").withColumn("z", leaky(F.col("s") + F.col("r")))
        elif form == "gatv2":
            s = h.select(F.col("node").alias("src"), F.col("x").alias("h"))
            r = affine(nodes, head["receive"]).select(F.col("node").alias("dst"), F.col("x").alias("r"))
            scored = e.join(s, "src").join(r, "dst").withColumn("z", dot(F.zip_with("h", "r", lambda a, b: leaky(a + b)), fixed(head["att"])))
        else:
            raise ValueError(f"unknown form {form!r}")
        shares = scatter_softmax(scored) if softmax else scored.withColumn("a", 1 / (1 + F.exp(-F.col("z"))))
        one = _mean(shares.select(F.col("dst").alias("node"), F.col("h").alias("x"), "a"), ["node"], F.col("a"), True).withColumnRenamed("x", f"h{i}")
        out = one if out is None else out.join(one, "node")
    cols = [F.col(f"h{i}") for i in range(len(heads))]
    x: Column = F.concat(*cols) if concat else cols[0]
    if not concat:
        for c in cols[1:]:
            x = F.zip_with(x, c, lambda a, b: a + b)
        x = F.transform(x, lambda v: v / len(heads))
    return out.select("node", (F.zip_with(x, fixed(bias), lambda a, b: a + b) if bias else x).alias("x"))


def relu(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))


def encoder(nodes: DataFrame, edges: DataFrame, layers: list[Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """The layers one after the other with relu between them and none after the last."""
    for i, layer in enumerate(layers):
        nodes = layer(relu(nodes) if i else nodes, edges)
    return nodes


def hashed_matrix(rows: int, columns: int, seed: int) -> Matrix:
    """Weights in [-1, 1) over the square root of rows, the same everywhere: md5 draws of (row, column, seed)."""
    import hashlib

    u = lambda i, j: int(hashlib.md5(f"{i}|{j}|{seed}".encode()).hexdigest()[:8], 16) / 4_294_967_296.0
    return [[(2 * u(i, j) - 1) / rows**0.5 for j in range(columns)] for i in range(rows)]


def random_projection(nodes: DataFrame, edges: DataFrame, columns: int, seed: int = 0) -> DataFrame:
    """[node, x]: own vector and neighbours' mean through an untrained affine map, as a product with a weight table."""
    both = effective_input(nodes, edges).select("node", F.posexplode("x").alias("i", "v"))
    spark = nodes.sparkSession
    width = 2 * (nodes.agg(F.max(F.size("x"))).first()[0] or 0)
    weights = spark.createDataFrame([(i, j, w) for i, r in enumerate(hashed_matrix(width, columns, seed)) for j, w in enumerate(r)], "i int, j int, w double")
    sums = both.join(F.broadcast(weights), "i").groupBy("node", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))  # inputs by columns
    return sums.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda p: p["v"]).alias("x"))


def pair_features(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs [u, v, ..] + x, the element-wise product of both ends, and score, its sum."""
    a, b = nodes.select(F.col("node").alias("u"), F.col("x").alias("xu")), nodes.select(F.col("node").alias("v"), F.col("x").alias("xv"))
    x = F.zip_with("xu", "xv", lambda p, q: p * q)
    return pairs.join(a, "u").join(b, "v").select(*pairs.columns, x.alias("x"), dot(F.col("xu"), F.col("xv")).alias("score"))


def scaler(rows: DataFrame, col: str = "x") -> DataFrame:
    """[pos, m, s]: mean and population SD of each element, to be kept and applied to later rows."""
    return rows.select(F.posexplode(col).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))


def apply_scaler(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """[node, x] standardised by kept statistics; an element without spread, and what is no number, becomes 0."""
    parts = rows.select("node", F.posexplode("x").alias("pos", "v")).join(F.broadcast(stats), "pos")  # a row an element
    z = F.try_divide(F.col("v") - F.col("m"), F.col("s"))
    good = F.when(F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(F.coalesce(z, F.lit(0.0)))
    return parts.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", good.alias("v")))), lambda p: p["v"]).alias("x"))


def inductive(new_nodes: DataFrame, new_edges: DataFrame, stored: DataFrame, stats: DataFrame, weights: Matrix) -> DataFrame:
    """[node, x] of new nodes only: scaled by the stored statistics, joined with the mean of their stored neighbours.

    new_edges are [src stored, dst new]; stored rows are read and stay as they are. Joins and one aggregate by new node, so
    new_nodes and new_edges can be a micro-batch of a stream.
    """
    own = apply_scaler(new_nodes, stats)
    seen = new_edges.join(stored, new_edges["src"] == stored["node"]).select(F.col("dst").alias("node"), "x")
    mean = _mean(seen, ["node"], F.lit(1.0)).withColumnRenamed("x", "m")
    both = own.join(mean, "node", "left").select("node", F.concat("x", F.coalesce("m", F.transform("x", lambda _: F.lit(0.0)))).alias("x"))
    return affine(both, weights)


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """[node, change]: the largest absolute difference of each node that both have."""
    b, a = before.select("node", F.col("x").alias("b")), after.select("node", F.col("x").alias("a"))
    return b.join(a, "node").select("node", F.array_max(F.zip_with("b", "a", lambda p, q: F.abs(p - q))).alias("change"))


def bernoulli_fan_out(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """[src, dst]: each edge kept with chance min(1, k over the receiver's degree), by a hash of the edge."""
    d = edges.groupBy("dst").agg(F.count("*").alias("d"))
    return edges.join(d, "dst").filter(draw("src", "dst", seed=seed) < F.lit(float(k)) / F.col("d")).select("src", "dst")


def readout_max(nodes: DataFrame) -> DataFrame:
    """[graph_id, x]: the element-wise maximum over a graph's nodes."""
    parts = nodes.select("graph_id", F.posexplode("x").alias("pos", "v")).groupBy("graph_id", "pos").agg(F.max("v").alias("v"))
    return parts.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x"))


def row_softmax(logits: Column) -> Column:
    """The softmax of an array, shifted by its maximum; maximum and sum are taken once a row, not once an element."""
    shifted = F.zip_with(logits, F.array_repeat(F.array_max(logits), F.size(logits)), lambda v, top: F.exp(v - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v)
    return F.zip_with(shifted, F.array_repeat(total, F.size(logits)), lambda v, t: v / t)


def ranked_by_hash(rows: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """rows whose draw is among the n lowest of their group (ties: smaller key)."""
    return within_quotas(rows, by, draw(key, seed=seed), key, {"_in": lambda _: F.lit(n)}).filter("_in").drop("_in")
