"""Queries on graph building and message passing with given weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.lineage import new_path, written
from weftline.functions.scalars import dot
from weftline.operators import builders, graph, passing, similar
from weftline.plans.base import query
from weftline.plans.graph_queries import FEATS, W, feats, long, sym
from weftline.sources import canonical as c
from weftline.streaming.arrivals import score_arrivals

UNIT = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) AS e FROM v),
s AS (SELECT a.id AS src, b.id AS dst, round(list_inner_product(a.e, b.e), 9) AS sim FROM u a JOIN u b ON a.id <> b.id)"""


def matrix(name: str, rows: list[list[float]]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {j + 1}, {x!r}::DOUBLE)" for i, r in enumerate(rows) for j, x in enumerate(r)) + ") t(i, j, w))"


def vectors(spark, d):
    return c.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("j7_similar_pairs", "src:i dst:i sim:f", "", UNIT + " SELECT * FROM s WHERE sim >= 0.4")
def _(spark, d):
    return similar.similar_pairs(similar.unit_vectors(vectors(spark, d)), 0.4)


@query("g6_threshold_graph", "src:i dst:i", "", UNIT + """, k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM s WHERE sim >= 0.3) WHERE r <= 8)
SELECT src, dst FROM k UNION SELECT dst, src FROM k""")
def _(spark, d):
    return builders.threshold_graph(vectors(spark, d), 0.3, 8)


@query("w8_most_similar", "src:i dst:i sim:f", "", UNIT + " SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM s WHERE sim >= 0.3) WHERE r <= 5")
def _(spark, d):
    return builders.most_similar(similar.similar_pairs(similar.unit_vectors(vectors(spark, d)), 0.3, 5), 5)


@query("g5_knn_graph", "src:i dst:i", "", UNIT + """, k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM s) WHERE r <= 4)
SELECT src, dst FROM k UNION SELECT dst, src FROM k""")
def _(spark, d):
    return builders.build("nearest", vectors=vectors(spark, d), k=4)


@query("g6_approximate_graph", "src:i dst:i", "", """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT 10 * id + k AS id, list_transform(e, lambda x, i: x + 0.02 * k * ((id + i) % 7 - 3) * sqrt(list_inner_product(e, e)) / 8) AS e FROM v, range(4) t(k)),
u AS (SELECT id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) AS e FROM c),
s AS (SELECT a.id AS src, b.id AS dst FROM u a JOIN u b ON a.id <> b.id AND list_inner_product(a.e, b.e) >= 0.9)
SELECT * FROM s""")
def _(spark, d):
    """Each vector with three moved copies, joined by the approximate path."""
    dealt = vectors(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few files would be moved by few tasks
    v = dealt.select("id", F.transform("vec", lambda x: x.cast("double")).alias("e")).withColumn("n", F.sqrt(dot(F.col("e"), F.col("e"))) / 8)
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    moved = v.select("id", "e", "n", k).select((10 * F.col("id") + F.col("k")).alias("id"), F.transform("e", lambda x, i: x + 0.02 * F.col("k") * ((F.col("id") + i + 1) % 7 - 3) * F.col("n")).alias("vec"))
    return builders.threshold_graph(moved, 0.9, 16, recall=0.999)


# ---- graphs of cascades; every tenth item has no cascade
TREE = """cn AS (SELECT item_id, node, uid, CASE WHEN node % 9 = 4 THEN NULL ELSE delay_min END AS delay_min, value FROM cascade_nodes WHERE item_id % 10 <> 3),
ce AS (SELECT * FROM cascade_edges WHERE item_id % 10 <> 3),
fx AS (SELECT item_id, [avg(value), count(*) / 50.0] AS x FROM cascade_nodes GROUP BY 1),
sz AS (SELECT item_id, count(*) AS n FROM cn GROUP BY 1),
pn AS (SELECT fx.item_id AS graph_id, coalesce(cn.node, 0) AS node, fx.x || CASE WHEN cn.node IS NULL THEN [0.0::DOUBLE, 0.0, 0.0] ELSE [cn.value, ln(1 + greatest(coalesce(cn.delay_min, 0), 0)), cn.node / n] END AS x
  FROM fx LEFT JOIN cn ON fx.item_id = cn.item_id LEFT JOIN sz ON sz.item_id = fx.item_id),
pe0 AS (SELECT item_id AS graph_id, parent AS src, child AS dst FROM ce UNION SELECT item_id, 0, node FROM cn WHERE node > 0),
pe AS (SELECT graph_id, src, dst FROM pe0 WHERE src <> dst UNION SELECT graph_id, dst, src FROM pe0 WHERE src <> dst)"""
LONG = "SELECT graph_id, node, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM "
HET = TREE + """, us AS (SELECT item_id AS graph_id, uid, (SELECT n FROM sz WHERE sz.item_id = q.item_id) + row_number() OVER (PARTITION BY item_id ORDER BY uid) - 1 AS node FROM (SELECT DISTINCT item_id, uid FROM cn) q),
wr AS (SELECT us.graph_id, us.node AS usr, cn.node FROM us JOIN cn ON us.graph_id = cn.item_id AND us.uid = cn.uid),
pl AS (""" + LONG + """ pn),
ul AS (SELECT wr.graph_id, wr.usr AS node, pos, avg(v) AS v FROM wr JOIN pl ON wr.graph_id = pl.graph_id AND wr.node = pl.node GROUP BY 1, 2, 3)"""


def tree(spark, d):
    has = F.col("item_id") % 10 != 3
    all_nodes = c.cascade_nodes(spark, d)
    n = all_nodes.filter(has).select("item_id", "node", "uid", F.when(F.col("node") % 9 != 4, F.col("delay_min")).alias("delay_min"), F.array("value").alias("profile"))
    x = all_nodes.groupBy("item_id").agg(F.array(F.avg("value"), F.count("*") / 50.0).alias("x"))
    return {"nodes": n, "edges": c.cascade_edges(spark, d).filter(has), "features": x}


def long_nodes(df):
    return df.select(*[x for x in df.columns if x != "x"], F.posexplode("x").alias("p", "v")).withColumn("pos", F.col("p") + 1)


@query("g8_propagation_nodes", "graph_id:i node:i pos:i v:f", "cascade_nodes cascade_edges", f"{TREE} {LONG} pn")
def _(spark, d):
    return long_nodes(builders.build("propagation", **tree(spark, d))[0])


@query("g8_propagation_edges", "graph_id:i src:i dst:i", "cascade_nodes cascade_edges", f"{TREE} SELECT * FROM pe")
def _(spark, d):
    return builders.build("propagation", **tree(spark, d))[1]


@query("g9_post_user_nodes", "graph_id:i node:i node_type:i pos:i v:f", "cascade_nodes cascade_edges", HET + " SELECT graph_id, node, 0 AS node_type, pos, v FROM pl UNION ALL SELECT graph_id, node, 1, pos, v FROM ul")
def _(spark, d):
    return long_nodes(builders.heterogeneous_graph(**tree(spark, d))[0])


@query("g9_post_user_edges", "graph_id:i src:i dst:i", "cascade_nodes cascade_edges", HET + " SELECT * FROM pe UNION ALL SELECT graph_id, usr, node FROM wr UNION ALL SELECT graph_id, node, usr FROM wr")
def _(spark, d):
    return builders.heterogeneous_graph(**tree(spark, d))[1]


@query("g11_collate", "part:i graph_id:i nodes:i", "cascade_nodes cascade_edges", HET + """ SELECT 0 AS part, graph_id, count(*) AS nodes FROM pn GROUP BY 2
UNION ALL SELECT 1, graph_id, count(*) FROM (SELECT graph_id, node FROM pn UNION ALL SELECT graph_id, node FROM us) GROUP BY 2""")
def _(spark, d):
    t = tree(spark, d)
    return builders.collate([builders.propagation_graph(**t), builders.heterogeneous_graph(**t)])[0].groupBy("part", "graph_id").agg(F.count("*").alias("nodes"))


STATS = "graphs:i nodes:i edges:i mean_degree:f max_degree:i isolated:f mean_nodes:f median_nodes:f max_nodes:i mean_edges:f edgeless:f"


@query("a18_graph_stats", STATS, "cascade_nodes cascade_edges", TREE + """, dg AS (SELECT p.graph_id, p.node, count(e.src) AS d FROM pn p LEFT JOIN pe e ON e.graph_id = p.graph_id AND e.dst = p.node GROUP BY 1, 2),
g AS (SELECT graph_id, count(*) AS n, sum(d) AS e, max(d) AS m, count(*) FILTER (WHERE d = 0) AS i FROM dg GROUP BY 1)
SELECT count(*) AS graphs, sum(n) AS nodes, sum(e) AS edges, sum(e) / sum(n) AS mean_degree, max(m) AS max_degree, sum(i) / sum(n) AS isolated, avg(n) AS mean_nodes, median(n) AS median_nodes, max(n) AS max_nodes, avg(e) AS mean_edges, avg((e = 0)::INTEGER) AS edgeless FROM g""")
def _(spark, d):
    return builders.graph_stats(*builders.propagation_graph(**tree(spark, d)))


ZERO = FEATS + ", zf AS (SELECT node, CASE WHEN node % 3 = 0 THEN 0 ELSE 1 END AS f FROM f), both_f AS (SELECT s.* FROM sym s JOIN zf a ON a.node = src AND a.f = 1 JOIN zf b ON b.node = dst AND b.f = 1)"


def some_zero(spark, d):
    return feats(spark, d).select("node", F.when(F.col("node") % 3 != 0, F.col("x")).otherwise(F.array_repeat(F.lit(0.0), 3)).alias("x"))


@query("g29_restrict", "src:i dst:i", "posts reply_edges", ZERO + " SELECT * FROM both_f")
def _(spark, d):
    return builders.restrict(sym(spark, d), some_zero(spark, d))


@query("j3_both_ends", "src:i dst:i", "posts reply_edges", FEATS + " SELECT src, dst FROM sym WHERE src % 4 <> 1 AND dst % 4 <> 1 AND src IN (SELECT node FROM f) AND dst IN (SELECT node FROM f)")
def _(spark, d):
    return builders.within(sym(spark, d), feats(spark, d).filter("node % 4 <> 1"))


@query("a19_degeneracy", "edges:i featured:i share:f isolated:i median_degree:f zero_means:f median_featured:f", "posts reply_edges", ZERO + """,
lb AS (SELECT node FROM f WHERE node % 5 <> 0), nr AS (SELECT l.node, count(s.src) AS d, count(*) FILTER (WHERE z.f = 1) AS k FROM lb l LEFT JOIN sym s ON s.dst = l.node LEFT JOIN zf z ON z.node = s.src GROUP BY 1)
SELECT (SELECT count(*) FROM sym) AS edges, (SELECT count(*) FROM both_f) AS featured, (SELECT count(*) FROM both_f) / (SELECT count(*) FROM sym) AS share, (SELECT count(*) FROM lb WHERE node NOT IN (SELECT dst FROM both_f)) AS isolated,
median(d) AS median_degree, avg((k = 0)::INTEGER) AS zero_means, median(CASE WHEN d > 0 THEN k / d END) AS median_featured FROM nr""")
def _(spark, d):
    return builders.degeneracy(sym(spark, d), some_zero(spark, d), feats(spark, d).filter("node % 5 <> 0"))


@query("g14_unrolled", "root:i level:i node:i n:i", "posts reply_edges", FEATS + """, l0 AS (SELECT node AS root, node, 1 AS n FROM f WHERE node % 50 = 0),
l1 AS (SELECT root, node, sum(n) AS n FROM (SELECT * FROM l0 UNION ALL SELECT root, dst, n FROM l0 JOIN sym ON src = node) GROUP BY 1, 2),
l2 AS (SELECT root, node, sum(n) AS n FROM (SELECT * FROM l1 UNION ALL SELECT root, dst, n FROM l1 JOIN sym ON src = node) GROUP BY 1, 2)
SELECT root, 0 AS level, node, n FROM l0 UNION ALL SELECT root, 1, node, n FROM l1 UNION ALL SELECT root, 2, node, n FROM l2""")
def _(spark, d):
    return builders.unrolled(sym(spark, d), feats(spark, d).filter("node % 50 = 0").select("node"), 3)


# ---- message passing
@query("g15_self_loops", "src:i dst:i", "posts reply_edges", FEATS + " SELECT src, dst FROM sym UNION ALL SELECT node, node FROM f")
def _(spark, d):
    return passing.with_loops(feats(spark, d), sym(spark, d))


@query("g19_mean_weights", "src:i dst:i w:f", "reply_edges posts", FEATS + " SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY dst) AS w FROM sym")
def _(spark, d):
    return passing.mean_weights(sym(spark, d))


ROWS = FEATS + """, se AS (SELECT src, dst FROM sym UNION ALL SELECT node, node FROM f), rn AS (SELECT dst AS node, pos, avg(v) AS v FROM se JOIN fl ON src = node GROUP BY 1, 2)"""


@query("g20_row_normalised", "node:i pos:i v:f", "posts reply_edges", ROWS + " SELECT * FROM rn")
def _(spark, d):
    return long(passing.row_normalised(feats(spark, d), sym(spark, d)))


P = [[0.3, -0.1, 0.2], [0.2, 0.4, -0.3], [-0.2, 0.1, 0.5]]
POOL = FEATS + ", " + matrix("pm", P) + ", " + matrix("wt", W) + """,
pl AS (SELECT node, j AS pos, greatest(sum(v * w), 0) AS v FROM fl JOIN pm ON i = pos GROUP BY 1, 2),
ag AS (SELECT a.node, a.pos, coalesce(g.mx, 0) AS mx, coalesce(g.mn, 0) AS mn FROM fl a LEFT JOIN (SELECT dst AS node, pos, max(v) AS mx, avg(v) AS mn FROM sym JOIN pl ON src = node GROUP BY 1, 2) g ON a.node = g.node AND a.pos = g.pos),
pr AS (SELECT node, j AS pos, sum(v * w) AS own FROM fl JOIN wt ON i = pos GROUP BY 1, 2)"""

for reduce, col in (("max", "mx"), ("mean", "mn")):

    @query(f"g21_sage_pool_{reduce}", "node:i pos:i v:f", "posts reply_edges", POOL + f" SELECT pr.node, pr.pos, own + g.v AS v FROM pr JOIN (SELECT node, j AS pos, sum({col} * w) AS v FROM ag JOIN wt ON i = pos + 3 GROUP BY 1, 2) g ON g.node = pr.node AND g.pos = pr.pos")
    def _(spark, d, reduce=reduce):
        return long(passing.sage(feats(spark, d), sym(spark, d), W, "pool", P, reduce))


@query("g21_sage_sum_unit", "node:i pos:i v:f", "posts reply_edges", FEATS + ", " + matrix("wt", W) + """,
ag AS (SELECT a.node, a.pos, a.v, coalesce(g.s, 0) AS s FROM fl a LEFT JOIN (SELECT dst AS node, pos, sum(v) AS s FROM sym JOIN fl ON src = node GROUP BY 1, 2) g ON a.node = g.node AND a.pos = g.pos),
z AS (SELECT node, x.j AS pos, sum(v * x.w + s * y.w) + CASE x.j WHEN 1 THEN 0.5 ELSE -0.25 END AS v FROM ag JOIN wt x ON x.i = pos JOIN wt y ON y.i = pos + 3 AND y.j = x.j GROUP BY 1, x.j)
SELECT node, pos, v / sqrt(sum(v * v) OVER (PARTITION BY node)) AS v FROM z""")
def _(spark, d):
    return long(passing.sage(feats(spark, d), sym(spark, d), W, "sum", bias=[0.5, -0.25], normalise=True))


R = passing.hashed_matrix(6, 4, 3)


@query("g22_random_projection", "node:i pos:i v:f", "posts reply_edges", FEATS + ", " + matrix("rm", R) + """,
ef AS (SELECT node, pos, v FROM fl UNION ALL SELECT a.node, a.pos + 3, coalesce(g.m, 0) FROM fl a LEFT JOIN (SELECT dst AS node, pos, avg(v) AS m FROM sym JOIN fl ON src = node GROUP BY 1, 2) g ON a.node = g.node AND a.pos = g.pos)
SELECT node, j AS pos, sum(v * w) AS v FROM ef JOIN rm ON i = pos GROUP BY 1, 2""")
def _(spark, d):
    return long(passing.random_projection(feats(spark, d), sym(spark, d), 4, seed=3))


@query("g23_gin_mlp", "node:i pos:i v:f", "posts reply_edges", FEATS + ", " + matrix("a", P) + ", " + matrix("b", W[:3]) + """,
h AS (SELECT o.node, o.pos, 1.1 * o.v + coalesce(g.s, 0) AS v FROM fl o LEFT JOIN (SELECT dst AS node, pos, sum(v) AS s FROM sym JOIN fl ON src = node GROUP BY 1, 2) g ON o.node = g.node AND o.pos = g.pos),
m AS (SELECT node, j AS pos, greatest(sum(v * w), 0) AS v FROM h JOIN a ON i = pos GROUP BY 1, 2)
SELECT node, j AS pos, sum(v * w) + 0.1 AS v FROM m JOIN b ON i = pos GROUP BY 1, 2""")
def _(spark, d):
    return long(passing.gin(feats(spark, d), sym(spark, d), 0.1, P, W[:3], second_bias=[0.1, 0.1]))


SEND, RECV = [W[:3], [[0.02, 0.1], [-0.3, 0.2], [0.05, 0.1]]], [[[0.1, -0.1], [0.2, 0.1], [0.05, -0.05]], [[-0.1, 0.2], [0.1, 0.1], [0.02, 0.03]]]
FROM, TO, ATT = [[0.02, 0.1], [0.05, -0.02]], [[0.03, -0.01], [0.04, 0.02]], [[0.1, 0.2], [-0.1, 0.3]]


def _heads(form: str) -> str:
    sql = FEATS + ", se AS (SELECT src, dst FROM sym UNION ALL SELECT node, node FROM f)"
    for k in (0, 1):
        sql += f", {matrix(f's{k}', SEND[k])}, {matrix(f'r{k}', RECV[k])}, h{k} AS (SELECT node, j AS pos, sum(v * w) AS v FROM fl JOIN s{k} ON i = pos GROUP BY 1, 2), q{k} AS (SELECT node, j AS pos, sum(v * w) AS v FROM fl JOIN r{k} ON i = pos GROUP BY 1, 2)"
        if form == "gat":
            sql += f", z{k} AS (SELECT src, dst, CASE WHEN t > 0 THEN t ELSE 0.2 * t END AS z FROM (SELECT src, dst, sum(a.v * CASE a.pos WHEN 1 THEN {FROM[k][0]} ELSE {FROM[k][1]} END + b.v * CASE b.pos WHEN 1 THEN {TO[k][0]} ELSE {TO[k][1]} END) AS t FROM se JOIN h{k} a ON a.node = src JOIN h{k} b ON b.node = dst AND b.pos = a.pos GROUP BY 1, 2))"
        else:
            sql += f", z{k} AS (SELECT src, dst, sum(CASE WHEN t > 0 THEN t ELSE 0.2 * t END * CASE pos WHEN 1 THEN {ATT[k][0]} ELSE {ATT[k][1]} END) AS z FROM (SELECT src, dst, a.pos, a.v + b.v AS t FROM se JOIN h{k} a ON a.node = src JOIN q{k} b ON b.node = dst AND b.pos = a.pos) GROUP BY 1, 2)"
    return sql


@query("g24_gat_heads", "node:i pos:i v:f", "posts reply_edges", _heads("gat") + "".join(f", e{k} AS (SELECT src, dst, exp(z - max(z) OVER (PARTITION BY dst)) AS e FROM z{k}), o{k} AS (SELECT dst AS node, pos + {2 * k} AS pos, sum(v * e) / sum(e) AS v FROM e{k} JOIN h{k} ON src = node GROUP BY 1, 2)" for k in (0, 1)) + " SELECT * FROM o0 UNION ALL SELECT * FROM o1")
def _(spark, d):
    return long(passing.attention(feats(spark, d), sym(spark, d), [{"send": SEND[k], "from": FROM[k], "to": TO[k]} for k in (0, 1)]))


@query("g24_gatv2_sigmoid", "node:i pos:i v:f", "posts reply_edges", _heads("gatv2") + "".join(f", o{k} AS (SELECT dst AS node, pos, sum(v / (1 + exp(-z))) AS v FROM z{k} JOIN h{k} ON src = node GROUP BY 1, 2)" for k in (0, 1)) + " SELECT o0.node, o0.pos, (o0.v + o1.v) / 2 + 0.3 AS v FROM o0 JOIN o1 ON o0.node = o1.node AND o0.pos = o1.pos")
def _(spark, d):
    return long(passing.attention(feats(spark, d), sym(spark, d), [{"send": SEND[k], "receive": RECV[k], "att": ATT[k]} for k in (0, 1)], "gatv2", softmax=False, concat=False, bias=[0.3, 0.3]))


@query("g25_readout_max", "graph_id:i pos:i v:f", "cascade_nodes cascade_edges", f"{TREE}, l AS ({LONG} pn) SELECT graph_id, pos, max(v) AS v FROM l GROUP BY 1, 2")
def _(spark, d):
    return long_nodes(passing.readout_max(builders.propagation_graph(**tree(spark, d))[0]))


@query("g26_encoder", "node:i pos:i v:f", "posts reply_edges", ROWS + ", " + matrix("a", P) + ", " + matrix("b", W[:3]) + """,
h AS (SELECT node, j AS pos, greatest(sum(v * w), 0) AS v FROM rn JOIN a ON i = pos GROUP BY 1, 2), r2 AS (SELECT dst AS node, pos, avg(v) AS v FROM se JOIN h ON src = node GROUP BY 1, 2)
SELECT node, j AS pos, sum(v * w) AS v FROM r2 JOIN b ON i = pos GROUP BY 1, 2""")
def _(spark, d):
    layers = [lambda n, e: graph.affine(passing.row_normalised(n, e), P), lambda n, e: graph.affine(passing.row_normalised(n, e), W[:3])]
    return long(passing.encoder(feats(spark, d), sym(spark, d), layers))


@query("g27_pair_features", "u:i v:i pos:i value:f score:f", "posts reply_edges", FEATS + """ SELECT s.src AS u, s.dst AS v, a.pos, a.v * b.v AS value, sum(a.v * b.v) OVER (PARTITION BY s.src, s.dst) AS score
FROM sym s JOIN fl a ON a.node = s.src JOIN fl b ON b.node = s.dst AND b.pos = a.pos WHERE s.src < s.dst""")
def _(spark, d):
    pairs = sym(spark, d).filter("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return passing.pair_features(pairs, feats(spark, d)).select("u", "v", F.posexplode("x").alias("p", "value"), "score").withColumn("pos", F.col("p") + 1)


INDUCTIVE = FEATS + ", " + matrix("wt", W) + """, st AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM fl WHERE node % 10 <> 0 GROUP BY pos),
sc AS (SELECT node, pos, coalesce((v - m) / nullif(s, 0), 0) AS v FROM fl JOIN st USING (pos)),
mn AS (SELECT dst AS node, pos, avg(v) AS v FROM sym JOIN sc ON src = node WHERE src % 10 <> 0 AND dst % 10 = 0 GROUP BY 1, 2),
ef AS (SELECT node, pos, v FROM sc WHERE node % 10 = 0 UNION ALL SELECT a.node, a.pos + 3, coalesce(mn.v, 0) FROM sc a LEFT JOIN mn ON mn.node = a.node AND mn.pos = a.pos WHERE a.node % 10 = 0)
SELECT node, j AS pos, sum(v * w) AS v FROM ef JOIN wt ON i = pos GROUP BY 1, 2"""


def arrivals(spark, d):
    f = feats(spark, d)
    old, new = f.filter("node % 10 <> 0"), f.filter("node % 10 = 0")
    stats = passing.scaler(old)
    return new, sym(spark, d).filter("src % 10 <> 0 AND dst % 10 = 0"), passing.apply_scaler(old, stats), stats


@query("g28_inductive", "node:i pos:i v:f", "posts reply_edges", INDUCTIVE)
def _(spark, d):
    """Every tenth node arrives late: it is scored from the statistics and vectors of the others."""
    new, edges, stored, stats = arrivals(spark, d)
    return long(passing.inductive(new, edges, stored, stats, W))


@query("g28_stream", "node:i pos:i v:f", "posts reply_edges", INDUCTIVE)
def _(spark, d):
    """The same, from a stream of files that holds the late nodes with their neighbours."""
    new, edges, stored, stats = arrivals(spark, d)
    near = edges.groupBy(F.col("dst").alias("node")).agg(F.collect_list("src").alias("near"))
    source, out = new_path(spark), new_path(spark)
    new.join(near, "node", "left").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("node long, x array<double>, near array<bigint>").option("maxFilesPerTrigger", 1).parquet(source)
    score_arrivals(stream, written(stored), written(stats), W, out, new_path(spark), once=True).awaitTermination()
    return long(spark.read.schema("node long, x array<double>").parquet(out))


@query("g30_change", "node:i change:f", "posts reply_edges", FEATS + """, e1 AS (SELECT src, dst FROM sym WHERE src % 10 <> 0 AND dst % 10 <> 0), n1 AS (SELECT node FROM f WHERE node % 10 <> 0),
before AS (SELECT dst AS node, pos, avg(v) AS v FROM (SELECT src, dst FROM e1 UNION ALL SELECT node, node FROM n1) JOIN fl ON src = node GROUP BY 1, 2),
after AS (SELECT dst AS node, pos, avg(v) AS v FROM (SELECT src, dst FROM sym UNION ALL SELECT node, node FROM f) JOIN fl ON src = node GROUP BY 1, 2)
SELECT b.node, max(abs(a.v - b.v)) AS change FROM before b JOIN after a ON a.node = b.node AND a.pos = b.pos GROUP BY 1""")
def _(spark, d):
    """What the arrival of every tenth node does to the others' row-normalised propagation."""
    f, e = feats(spark, d), sym(spark, d)
    old = f.filter("node % 10 <> 0")
    return passing.change(passing.row_normalised(old, builders.within(e, old)), passing.row_normalised(f, e))


@query("r4_bernoulli_fan_out", "src:i dst:i", "reply_edges posts", FEATS + " SELECT src, dst FROM (SELECT *, count(*) OVER (PARTITION BY dst) AS d FROM sym) WHERE ('0x' || substr(md5(src || '|' || dst || '|8'), 1, 8))::UBIGINT / 4294967296.0 < 5.0 / d")
def _(spark, d):
    return passing.bernoulli_fan_out(sym(spark, d), 5, seed=8)


@query("f17_softmax", "node:i pos:i v:f", "posts reply_edges", FEATS + " SELECT node, pos, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS v FROM fl WINDOW w AS (PARTITION BY node)")
def _(spark, d):
    return long(feats(spark, d).select("node", passing.row_softmax(F.col("x")).alias("x")))


@query("f20_kept_scaler", "node:i pos:i v:f", "posts reply_edges", FEATS + ", st AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM fl WHERE node % 2 = 0 GROUP BY pos) SELECT node, pos, coalesce((v - m) / nullif(s, 0), 0) AS v FROM fl JOIN st USING (pos) WHERE node % 2 = 1")
def _(spark, d):
    f = feats(spark, d)
    return long(passing.apply_scaler(f.filter("node % 2 = 1"), passing.scaler(f.filter("node % 2 = 0"))))
