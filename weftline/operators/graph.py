"""Graph algorithms and message passing on [src, dst] edges and [node, x ARRAY<DOUBLE>] features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from weftline.functions.lineage import ordered_index, written


def adjacency(edges: DataFrame) -> DataFrame:
    """[node, others ARRAY]: sorted neighbour lists."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("others"))


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """[node, rank, residual] on directed simple edges; dangling mass spreads evenly.

    Iterates until the ranks' total change, the residual, is under tolerance times the number of nodes, or so many times.
    """
    e = written(edges.select("src", "dst").distinct())
    nodes = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    links = written(e.join(out, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    heads = written(out.select(F.col("src").alias("node")))
    residual = 0.0
    for _ in range(iterations):
        loose = ranks.join(heads, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        got = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        step = ranks.join(got, ranks["node"] == got["dst"], "left").join(F.broadcast(loose), how="cross")  # one row
        ranks = written(step.select("node", F.col("rank").alias("old"), ((1 - damping) / max(n, 1) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / max(n, 1))).alias("rank")))
        residual = ranks.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()[0]
        ranks = ranks.drop("old")
        if residual < tolerance * n:
            break
    return ranks.withColumn("residual", F.lit(residual))


#: Pairs of links that a task multiplies out at a time.
MEET_ROWS = 2_000_000


def common_neighbours(edges: DataFrame, max_degree: int | None = None, blocks: int = 16) -> DataFrame:
    """[u, v, n, adamic_adar] of node pairs with a shared neighbour of degree over 1, on a symmetric simple graph.

    The work is the sum of squared degrees, as the definition asks; what is shuffled is not. Nodes are dealt over blocks, and
    the links of two blocks meet in one task, which has all that their pairs share: each link is sent blocks + 1 times,
    and no pair. A task multiplies out a bounded number of rows at a time; max_degree leaves out larger hubs.
    """
    deg = edges.groupBy("dst").agg(F.count("*").alias("d")).filter("d > 1" if max_degree is None else f"d > 1 AND d <= {max_degree}")
    block = F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int")
    linked = edges.filter("src IS NOT NULL").join(deg, "dst").select("src", "dst", "d", block.alias("b"))
    cell = lambda low, high: (high * (high + 1) / 2).cast("int") + low
    first = F.transform(F.sequence("b", F.lit(blocks - 1)), lambda j: F.struct(cell(F.col("b"), j).alias("cell"), F.lit(True).alias("first")))
    second = F.transform(F.sequence(F.lit(0), "b"), lambda i: F.struct(cell(i, F.col("b")).alias("cell"), F.lit(False).alias("first")))
    sent = linked.select(F.explode(F.concat(first, second)).alias("c"), F.col("src").alias("n"), F.col("dst").alias("m"), "d")
    dealt = sent.select("c.cell", "c.first", "n", "m", F.when(F.col("c.first"), F.col("d")).alias("d")).repartitionById(blocks * (blocks + 1) // 2, F.col("cell"))
    diagonal = [high * (high + 3) // 2 for high in range(blocks)]
    kind = edges.schema["src"].dataType

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = pa.Table.from_batches(held)
        kind_arrow = x.schema.field("n").type
        del held
        own = x["cell"][0].as_py() in diagonal
        side = x["first"].to_numpy()
        shared, m = np.unique(x["m"].to_numpy(), return_inverse=True)
        (us, u), (vs, v) = (np.unique(x["n"].to_numpy()[s], return_inverse=True) for s in (side, ~side))
        mu, mv, weight = m[side], m[~side], 1 / np.log(x["d"].to_numpy()[side])
        del x, m
        by = np.argsort(u, kind="stable")
        u, mu, weight = u[by], mu[by], weight[by]
        by = np.argsort(mv, kind="stable")
        v, size = v[by], np.bincount(mv, minlength=len(shared))
        start, made = np.cumsum(size) - size, np.cumsum(size[mu])

        def products(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Links a to b of the first side with each link of the second that shares their m: (place in the first, v, weight)."""
            k = size[mu[a:b]]
            at = np.repeat(start[mu[a:b]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            return np.repeat(np.arange(a, b), k), v[at], np.repeat(weight[a:b], k)

        def rows(one: np.ndarray, two: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            p, q = us[one], vs[two]
            keep = p < q if own else slice(None)
            p, q = p[keep], q[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), kind_arrow), pa.array(np.maximum(p, q), kind_arrow), pa.array(n[keep], pa.int64()), pa.array(s[keep], pa.float64())], ["u", "v", "n", "adamic_adar"])

        a = 0
        while a < len(u):
            before = made[a - 1] if a else 0
            b = int(np.searchsorted(made, before + MEET_ROWS, "right"))
            b = len(u) if b >= len(u) else int(np.searchsorted(u, u[b]))
            if b > a:
                place, two, w = products(a, b)
                pair, at = np.unique(u[place] * len(vs) + two, return_inverse=True)
                n, s = np.bincount(at, minlength=len(pair)), np.bincount(at, w, len(pair))
                one, two = np.divmod(pair, max(len(vs), 1))
            else:  # one node of very many products: they are added up in pieces
                b = int(np.searchsorted(u, u[a], "right"))
                n, s, c = np.zeros(len(vs), np.int64), np.zeros(len(vs)), a
                while c < b:
                    e = min(b, max(c + 1, int(np.searchsorted(made, (made[c - 1] if c else 0) + MEET_ROWS, "right"))))
                    _, some, w = products(c, e)
                    n += np.bincount(some, minlength=len(vs))
                    s += np.bincount(some, w, len(vs))
                    c = e
                two = np.flatnonzero(n)
                one, n, s = np.full(len(two), u[a]), n[two], s[two]
            if len(two):
                yield rows(one, two, n, s)
            a = b

    return dealt.mapInArrow(meet, StructType([StructField("u", kind), StructField("v", kind), StructField("n", LongType()), StructField("adamic_adar", DoubleType())]))


def rooted(links: DataFrame, keys: list[str]) -> DataFrame:
    """[keys, node, root, dist]: where each node's chain of parents ends and after how many steps, from links [keys, node, parent], one a node.

    Pointer doubling: in each round a node takes its pointer's pointer, so rounds grow with the logarithm of the depth. A
    round in which no chain ends leaves only cycles, which are left out.
    """
    state = live = written(links.select(*keys, "node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("dist")))
    done: list[DataFrame] = []
    while True:
        ahead = state.select(*keys, F.col("node").alias("root"), F.col("root").alias("next"), F.col("dist").alias("more"), F.lit(True).alias("on"))
        step = written(live.join(ahead, [*keys, "root"], "left"))
        done.append(step.filter("on IS NULL").select(*keys, "node", "root", "dist"))
        if done[-1].isEmpty():
            break
        live = written(step.filter("on").select(*keys, "node", F.col("next").alias("root"), (F.col("dist") + F.col("more")).alias("dist")))
        state = reduce(DataFrame.unionByName, [*done, live])
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def cascade_depths(edges: DataFrame) -> DataFrame:
    """[item_id, node, depth] of nodes reachable from node 0, by the shortest way.

    Chains of nodes of one parent are followed by pointer doubling, up to node 0 or to a node of several parents. Only those
    are visited by a frontier, over one edge a chain.
    """
    own = written(edges.filter("parent <> child AND child <> 0").groupBy("item_id", F.col("child").alias("node")).agg(F.countDistinct("parent").alias("n"), F.min("parent").alias("parent")))
    zero = edges.select("item_id").distinct().select("item_id", F.lit(0).alias("node"), F.lit(0).cast("long").alias("depth"))
    chains = written(rooted(own.filter("n = 1").select("item_id", "node", "parent"), ["item_id"]))
    out = [zero, chains.filter("root = 0").select("item_id", "node", F.col("dist").alias("depth"))]
    if not (several := own.filter("n > 1").select("item_id", "node")).isEmpty():
        came = edges.filter("parent <> child").select("item_id", F.col("child").alias("node"), "parent").join(several, ["item_id", "node"])
        led = came.join(chains.select("item_id", F.col("node").alias("parent"), "root", "dist"), ["item_id", "parent"], "left")
        jumps = written(led.groupBy("item_id", "node", F.coalesce("root", "parent").alias("root")).agg(F.min(F.coalesce("dist", F.lit(0)) + 1).alias("dist")))
        best = frontier = written(zero)
        while not frontier.isEmpty():
            reached = jumps.join(frontier.select("item_id", F.col("node").alias("root"), "depth"), ["item_id", "root"]).groupBy("item_id", "node").agg(F.min(F.col("depth") + F.col("dist")).alias("depth"))
            before = best.select("item_id", "node", F.col("depth").alias("old"))
            frontier = written(reached.join(before, ["item_id", "node"], "left").filter("old IS NULL OR depth < old").select("item_id", "node", "depth"))
            best = written(best.unionByName(frontier).groupBy("item_id", "node").agg(F.min("depth").alias("depth")))
        hubs = best.filter("node <> 0")
        out += [hubs, chains.join(hubs.select("item_id", F.col("node").alias("root"), "depth"), ["item_id", "root"]).select("item_id", "node", (F.col("dist") + F.col("depth")).alias("depth"))]
    return reduce(DataFrame.unionByName, out).withColumn("depth", F.col("depth").cast("int"))


def _mean(rows: DataFrame, keys: list[str], weight: Column, total: bool = False) -> DataFrame:
    """Element-wise weighted sums of x (divided by the row count unless total), one row a key."""
    parts = rows.select(*keys, F.posexplode("x").alias("pos", "val"), weight.alias("wt"))
    by = parts.groupBy(*keys, "pos").agg(F.sum(F.col("val") * F.col("wt")).alias("s"), F.count("*").alias("n"))
    value = F.col("s") if total else F.col("s") / F.col("n")
    return by.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda p: p["v"]).alias("x"))


def scatter(nodes: DataFrame, edges: DataFrame, how: str = "mean") -> DataFrame:
    """[node, x]: mean, sum or max of the senders' vectors by receiver; zeros for nodes that receive nothing."""
    sent = edges.join(nodes, edges["src"] == nodes["node"]).select(F.col("dst").alias("to"), "x")
    if how == "max":
        parts = sent.select("to", F.posexplode("x").alias("pos", "val")).groupBy("to", "pos").agg(F.max("val").alias("v"))
        got = parts.groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("got"))
    else:
        got = _mean(sent, ["to"], F.lit(1.0), how == "sum").withColumnRenamed("x", "got")
    zero = F.transform("x", lambda _: F.lit(0.0))
    return nodes.join(got, nodes["node"] == got["to"], "left").select("node", F.coalesce("got", zero).alias("x"))


def gcn(nodes: DataFrame, edges: DataFrame, norm: str = "symmetric") -> DataFrame:
    """[node, x]: one propagation with self-loops; symmetric D^-1/2 A D^-1/2, or paper: self plus neighbours over max(1, |N|)."""
    deg = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("d"))
    full = nodes.join(deg, "node", "left").select("node", "x", F.coalesce("d", F.lit(0)).alias("d"))
    e = edges.select("src", "dst").union(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    to = full.select(F.col("node").alias("to"), F.col("d").alias("dt"))
    sent = e.join(full, e["src"] == full["node"]).select("dst", "x", "d").join(to, F.col("dst") == F.col("to"))
    weight = 1 / F.sqrt((F.col("d") + 1) * (F.col("dt") + 1)) if norm == "symmetric" else 1 / F.greatest(F.col("dt"), F.lit(1)).cast("double")
    return _mean(sent.select(F.col("to").alias("node"), "x", weight.alias("w")), ["node"], F.col("w"), True)


def effective_input(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[node, x]: own vector followed by the neighbours' mean."""
    mean = scatter(nodes, edges).select("node", F.col("x").alias("m"))
    return nodes.join(mean, "node").select("node", F.concat("x", "m").alias("x"))


def affine(nodes: DataFrame, weights: list[list[float]], bias: list[float] | None = None, relu: bool = False) -> DataFrame:
    """[node, x W + b] with given weights (rows: inputs)."""
    cols = []
    for j in range(len(weights[0])):
        z = sum((F.element_at("x", i + 1) * w[j] for i, w in enumerate(weights)), F.lit(float(bias[j] if bias else 0)))
        cols.append(F.greatest(z, F.lit(0.0)) if relu else z)
    return nodes.select("node", F.array(*cols).alias("x"))


def sage(nodes: DataFrame, edges: DataFrame, weights: list[list[float]]) -> DataFrame:
    """One mean-aggregator step with given weights on [own, neighbours' mean]."""
    return affine(effective_input(nodes, edges), weights)


def gin(nodes: DataFrame, edges: DataFrame, eps: float, weights: list[list[float]]) -> DataFrame:
    """One step: relu(((1 + eps) x + sum of neighbours) W)."""
    total = scatter(nodes, edges, "sum").select("node", F.col("x").alias("s"))
    h = nodes.join(total, "node").select("node", F.zip_with("x", "s", lambda a, b: a * (1 + eps) + b).alias("x"))
    return affine(h, weights, relu=True)


def scatter_softmax(scores: DataFrame) -> DataFrame:
    """[src, dst, z] + a: softmax by receiver, shifted by the receiver's maximum."""
    w = Window.partitionBy("dst")
    e = F.exp(F.col("z") - F.max("z").over(w))
    return scores.withColumn("e", e).withColumn("a", F.col("e") / F.sum("e").over(w)).drop("e")


def gat(nodes: DataFrame, edges: DataFrame, send: list[float], receive: list[float], slope: float = 0.2) -> DataFrame:
    """[node, x]: attention of one head; leaky relu of send.x_src + receive.x_dst, softmax by receiver, weighted sum."""
    own = lambda v: sum((F.element_at("x", i + 1) * c for i, c in enumerate(v)), F.lit(0.0))
    s = nodes.select(F.col("node").alias("src"), own(send).alias("s"), "x")
    r = nodes.select(F.col("node").alias("dst"), own(receive).alias("r"))
    z = F.col("s") + F.col("r")
    scored = edges.select("src", "dst").join(s, "src").join(r, "dst").withColumn("z", F.when(z > 0, z).otherwise(z * slope))
    return _mean(scatter_softmax(scored).select(F.col("dst").alias("node"), "x", "a"), ["node"], F.col("a"), True)


def readout(nodes: DataFrame, how: str = "mean") -> DataFrame:
    """[graph_id, x]: mean or sum over a graph's nodes, or its root (smallest node)."""
    if how == "root":
        return nodes.groupBy("graph_id").agg(F.min_by("x", "node").alias("x"))
    return _mean(nodes, ["graph_id"], F.lit(1.0), how == "sum")


def attribute_pairs(attributes: DataFrame, max_group: int = 200, seed: int = 0) -> DataFrame:
    """[src, dst] between items with a common attribute value, both ways; values held by more than max_group items are joined by max_group random rings."""
    size = written(attributes.groupBy("attr", "value").agg(F.count("*").alias("n")))
    a = attributes.join(size.filter(F.col("n") <= max_group).select("attr", "value"), ["attr", "value"])
    b = a.select("attr", "value", F.col("item_id").alias("dst"))
    pairs = a.join(b, ["attr", "value"]).filter("item_id < dst").select(F.col("item_id").alias("lo"), F.col("dst").alias("hi"))
    large = attributes.join(size.filter(F.col("n") > max_group).select("attr", "value"), ["attr", "value"])
    rings = random_rings(large, max_group, seed)
    once = pairs.unionByName(rings.filter("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))).distinct()
    ways = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return once.select(F.explode(ways).alias("e")).select("e.*")  # repeats went before the way back was made


#: Members of a ring that a task sorts.
RING_ROWS = 1_000_000


def random_rings(members: DataFrame, rounds: int, seed: int = 0) -> DataFrame:
    """[src, dst]: in each round the members [attr, value, item_id] of a group in an md5 order, each to the next, the last to the first.

    A ring is cut by its drawn order into slices of about RING_ROWS, so a large group is spread over tasks and no sample of
    the draws is taken. Edges are made as sorted rows stream by and only both ends of a slice are kept to close the ring:
    rows are drawn, shuffled and written once, as numbers of groups and rounds and two ids.
    """
    groups = written(ordered_index(members.groupBy("attr", "value").agg(F.count("*").alias("n")), F.col("attr"), F.col("value"), name="g"))
    most = (groups.agg(F.sum("n")).first()[0] or 0) * rounds
    digest = F.md5(F.concat_ws("|", "attr", "value", F.col("round").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed))).cast("binary"))
    named = members.alias("l").join(groups.alias("r"), F.col("l.attr").eqNullSafe(F.col("r.attr")) & F.col("l.value").eqNullSafe(F.col("r.value"))).select("l.attr", "l.value", "l.item_id", "r.g", "r.n")
    dealt = named.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("g", "round", "n", F.substring(digest, 1, 16).alias("h"), "item_id")
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4_294_967_296.0 * F.ceil(F.col("n") / RING_ROWS)).cast("int")
    dealt = dealt.select("g", "round", part.alias("part"), "h", "item_id")
    n, order = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // RING_ROWS)), ["g", "round", "part", "h", "item_id"]
    kind = members.schema["item_id"].dataType

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, first, last = None, None, None
        for batch in batches:
            g, r, p = (np.asarray(batch.column(c)) for c in ("g", "round", "part"))
            items = batch.column("item_id")
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(r) != 0) | (np.diff(p) != 0)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own = items.slice(a, b - a)
                if ring == (g[a], r[a], p[a]):
                    own = pa.concat_arrays([last, own])
                else:
                    if ring is not None:
                        yield ends(ring, first, last)
                    ring, first = (g[a], r[a], p[a]), own.slice(0, 1)
                last = own.slice(len(own) - 1)
                yield rows(None, None, None, own.slice(0, len(own) - 1), own.slice(1))
        if ring is not None:
            yield ends(ring, first, last)

    def rows(g, r, part, src: pa.Array, dst: pa.Array) -> pa.RecordBatch:
        k = len(src)
        return pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([g] * k, pa.int64()), pa.array([r] * k, pa.int32()), src, dst], ["part", "g", "round", "src", "dst"])

    def ends(ring: tuple, first: pa.Array, last: pa.Array) -> pa.RecordBatch:
        return rows(*(int(x) for x in ring), last, first)

    schema = StructType([StructField("part", IntegerType()), StructField("g", LongType()), StructField("round", IntegerType()), StructField("src", kind), StructField("dst", kind)])
    made = written(dealt.repartition(n, "g", "round", "part").sortWithinPartitions(*order).mapInArrow(link, schema))
    stretch = made.filter("g IS NOT NULL").select("part", "g", "round", F.col("src").alias("last"), F.col("dst").alias("first"))
    along = Window.partitionBy("g", "round").orderBy("part")  # a ring's slices
    closed = stretch.withColumn("dst", F.coalesce(F.lead("first").over(along), F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return made.filter("g IS NULL").select("src", "dst").unionByName(closed.select(F.col("last").alias("src"), "dst"))


def nearest(vectors: DataFrame, k: int = 4, queries: Column | None = None) -> DataFrame:
    """[id, other, sim, r]: each query's k most similar rows by cosine, ties to the smaller id; exact.

    Queries are the rows where a condition on id holds (default: every hundredth); they meet the rows in blocks.
    """
    from weftline.operators.similar import nearest_pairs, unit_vectors

    unit = unit_vectors(vectors, 0.0)
    asked = unit.filter(queries if queries is not None else F.col("id") % 100 == 0)
    return nearest_pairs(unit, k, asked).select(F.col("src").alias("id"), F.col("dst").alias("other"), "sim", "r")


def common_neighbours_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """[u, v, n, adamic_adar] of given pairs on a symmetric simple graph; 0 for pairs without a shared neighbour of degree over 1.

    Each pair follows the links of its end of fewer neighbours and looks the other one up by (node, neighbour), so the work
    is the sum of the smaller degrees and a hub's links are only read by pairs of hubs.
    """
    deg = written(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")))
    of = lambda end: deg.select(F.col("node").alias(end), F.col("d").alias(f"d_{end}"))
    wanted = written(pairs.select("u", "v").distinct())
    sized = wanted.join(of("u"), "u").join(of("v"), "v")
    less = F.col("d_u") <= F.col("d_v")
    asked = sized.select("u", "v", F.when(less, F.col("u")).otherwise(F.col("v")).alias("near"), F.when(less, F.col("v")).otherwise(F.col("u")).alias("far"))
    links = edges.select(F.col("src").alias("near"), F.col("dst").alias("m"))
    back = edges.select(F.col("src").alias("far"), F.col("dst").alias("m"))
    shared = asked.join(links, "near").join(back, ["far", "m"]).join(deg.filter("d > 1").withColumnRenamed("node", "m"), "m")
    got = shared.groupBy("u", "v").agg(F.count("*").alias("n"), F.sum(1 / F.ln("d")).alias("adamic_adar"))
    return wanted.join(got, ["u", "v"], "left").na.fill(0, ["n"]).na.fill(0.0, ["adamic_adar"])
