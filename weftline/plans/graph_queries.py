"""Queries on temporal networks, cascades, attribute graphs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph, temporal
from weftline.plans.base import query
from weftline.sources import canonical as c

MONTH = 30 * 86_400
SNAPS = """snaps AS (SELECT DISTINCT ((ts - (SELECT min(ts) FROM {e})) // {w})::INTEGER AS w, least(src, dst) AS u, greatest(src, dst) AS v FROM {e}),
nb AS (SELECT w, u AS node, v AS other FROM snaps UNION ALL SELECT w, v, u FROM snaps WHERE u <> v),
deg AS (SELECT w, node, sum(CASE WHEN node = other THEN 2 ELSE 1 END) AS deg FROM nb GROUP BY w, node),
prob AS (SELECT w, node, deg, deg / sum(deg) OVER (PARTITION BY w) AS p FROM deg),
lne AS (SELECT nb.w, nb.node, (ln(sum(pow(d.deg, 0.6))) - 0.6 * ln(sum(d.deg))) / 0.4 AS h,
  ln(sum(pow(d.p, 0.6))) / 0.4 AS h_global, ln(sum(d.deg)) - sum(d.deg * ln(d.deg)) / sum(d.deg) AS h_shannon
  FROM nb JOIN prob d ON nb.w = d.w AND nb.other = d.node GROUP BY nb.w, nb.node)"""
INTER, REPLY = SNAPS.format(e="interactions", w=MONTH), SNAPS.format(e="reply_edges", w=86_400)
SIMPLE = "sym AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM reply_edges UNION ALL SELECT dst, src FROM reply_edges) WHERE src <> dst)"


def inter(spark, d):
    return temporal.snapshots(c.interactions(spark, d), MONTH)


def daily(spark, d):
    return temporal.snapshots(c.reply_edges(spark, d), 86_400)


def sym(spark, d):
    return temporal.to_undirected(c.reply_edges(spark, d))


@query("entropy_timeline", "w:i h:f weighted_h:f", "interactions", INTER + """,
s AS (SELECT x.w, coalesce(g.h, 0) AS h FROM range((SELECT max(w) + 1 FROM snaps)) x(w) LEFT JOIN (SELECT w, sum(h) AS h FROM lne GROUP BY w) g ON g.w = x.w)
SELECT a.w, a.h, coalesce(sum(exp(-1.2 * (a.w - b.w)) * b.h), 0) AS weighted_h FROM s a LEFT JOIN s b ON b.w < a.w GROUP BY a.w, a.h""")
def _(spark, d):
    return temporal.weighted_series(temporal.global_entropy(inter(spark, d)))


@query("t1_snapshots", "w:i u:i v:i", "interactions", INTER + " SELECT w, u, v FROM snaps")
def _(spark, d):
    return inter(spark, d)


@query("g3_degrees", "w:i node:i deg:i p:f", "reply_edges", REPLY + " SELECT * FROM prob")
def _(spark, d):
    return temporal.node_probabilities(daily(spark, d))


@query("e8_local_entropy", "w:i node:i h:f", "reply_edges", REPLY + " SELECT w, node, h FROM lne")
def _(spark, d):
    return temporal.local_entropy(daily(spark, d))


def _ranks_sql(steps: int) -> str:
    sql = REPLY + """, od AS MATERIALIZED (SELECT w, node, count(*) AS d FROM nb GROUP BY 1, 2), tn AS (SELECT count(DISTINCT node) AS n FROM nb),
bs AS MATERIALIZED (SELECT w, 0.15 / n / (1 - 0.85 * (n - count(*)) / n) AS c FROM od, tn GROUP BY w, n), q0 AS (SELECT w, node, 1.0::DOUBLE / n AS r FROM od, tn)"""
    for i in range(steps):
        sql += f", q{i + 1} AS MATERIALIZED (SELECT q.w, q.node, c + 0.85 * g.g AS r FROM q{i} q JOIN bs ON bs.w = q.w JOIN (SELECT nb.w, nb.other AS node, sum(r / d) AS g FROM nb JOIN q{i} p ON p.w = nb.w AND p.node = nb.node JOIN od ON od.w = nb.w AND od.node = nb.node GROUP BY 1, 2) g ON g.w = q.w AND g.node = q.node)"
    return sql + f", qr AS (SELECT * FROM q{steps})"


@query("e7_pagerank_entropy", "w:i node:i h:f", "reply_edges", _ranks_sql(8) + " SELECT nb.w, nb.node, (ln(sum(pow(r, 0.6))) - 0.6 * ln(sum(r))) / 0.4 AS h FROM nb JOIN qr ON qr.w = nb.w AND qr.node = nb.other GROUP BY 1, 2")
def _(spark, d):
    """Eight steps on both sides, so that they agree to the last place; the operator's default runs to a tolerance."""
    return temporal.local_entropy(daily(spark, d), metric="pagerank", tolerance=0.0, iterations=8)


@query("e8_global_normalisation", "w:i node:i h:f", "reply_edges", REPLY + " SELECT w, node, h_global AS h FROM lne")
def _(spark, d):
    return temporal.local_entropy(daily(spark, d), normalisation="global")


@query("e1_shannon_limit", "w:i node:i h:f", "reply_edges", REPLY + " SELECT w, node, h_shannon AS h FROM lne")
def _(spark, d):
    return temporal.local_entropy(daily(spark, d), alpha=1.0)


@query("e9_static_entropy", "node:i h:f", "reply_edges", SIMPLE + """,
deg AS (SELECT src AS node, count(*) AS deg FROM sym GROUP BY src)
SELECT s.src AS node, (ln(sum(pow(d.deg, 0.6))) - 0.6 * ln(sum(d.deg))) / 0.4 AS h FROM sym s JOIN deg d ON s.dst = d.node GROUP BY s.src""")
def _(spark, d):
    return temporal.static_entropy(c.reply_edges(spark, d))


@query("e12_entropy_features", "node:i lne_last:f lne_tw:f", "interactions", INTER + """,
t AS (SELECT max(w) AS top FROM snaps)
SELECT node, sum(CASE WHEN w = top THEN h ELSE 0 END) AS lne_last, sum(exp(-1.2 * (top - w)) * h) AS lne_tw FROM lne, t GROUP BY node""")
def _(spark, d):
    return temporal.entropy_features(inter(spark, d))


@query("t2_chronological_split", "split:s n:i t0:i t1:i", "interactions", """SELECT CASE WHEN ts <= a + 0.8 * (b - a) THEN 'train' WHEN ts <= a + 0.9 * (b - a) THEN 'val' ELSE 'test' END AS split,
count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM interactions, (SELECT min(ts) AS a, max(ts) AS b FROM interactions) GROUP BY 1""")
def _(spark, d):
    s = temporal.chronological_split(c.interactions(spark, d), 0.8, 0.1)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))


@query("t3_new_links", "split:s u:i v:i", "reply_edges", """p AS (SELECT DISTINCT CASE WHEN ts <= a + 0.8 * (b - a) THEN 'train' WHEN ts <= a + 0.9 * (b - a) THEN 'val' ELSE 'test' END AS split, least(src, dst) AS u, greatest(src, dst) AS v
FROM reply_edges, (SELECT min(ts) AS a, max(ts) AS b FROM reply_edges) WHERE src <> dst)
SELECT * FROM p WHERE split <> 'train' AND (u, v) NOT IN (SELECT (u, v) FROM p WHERE split = 'train')""")
def _(spark, d):
    return temporal.new_links(temporal.chronological_split(c.reply_edges(spark, d)))


PAIRS = """pairs AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM reply_edges WHERE src <> dst),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM reply_edges UNION SELECT dst FROM reply_edges))"""


@query("r1_negatives", "i:i u:i v:i", "reply_edges", PAIRS + """, n AS (SELECT count(*) AS k, (SELECT count(*) FROM nodes) AS size FROM pairs),
dr AS (SELECT i, floor(('0x' || substr(md5(i || '|a|5'), 1, 8))::UBIGINT / 4294967296.0 * size)::BIGINT AS a, floor(('0x' || substr(md5(i || '|b|5'), 1, 8))::UBIGINT / 4294967296.0 * size)::BIGINT AS b FROM n, range(200 * (SELECT k FROM n)) r(i)),
p AS (SELECT i, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v FROM dr JOIN nodes x ON a = x.idx JOIN nodes y ON b = y.idx WHERE a <> b)
SELECT i, u, v FROM p WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.u = p.u AND pairs.v = p.v) ORDER BY i LIMIT (SELECT k FROM n)""")
def _(spark, d):
    e = c.reply_edges(spark, d)
    pairs = temporal.undirected_pairs(e)
    return temporal.sample_negatives(e.select(F.col("src").alias("node")).union(e.select("dst")), pairs, pairs.count(), seed=5)


@query("r3_fan_out", "src:i dst:i", "reply_edges", SIMPLE + """
SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ('0x' || substr(md5(src || '|' || dst || '|3'), 1, 8))::UBIGINT, dst) AS r FROM sym) WHERE r <= 5""")
def _(spark, d):
    return temporal.fan_out(sym(spark, d), 5, seed=3)


@query("u4_undirected", "src:i dst:i", "reply_edges", SIMPLE + " SELECT * FROM sym")
def _(spark, d):
    return sym(spark, d)


@query("a24_edge_growth", "day:i n:i share:f", "interactions", "SELECT day, n, sum(n) OVER (ORDER BY day) / sum(n) OVER () AS share FROM (SELECT ts // 86400 AS day, count(*) AS n FROM interactions GROUP BY 1)")
def _(spark, d):
    return temporal.edge_growth(c.interactions(spark, d))


@query("a1_edge_summary", "nodes:i edges:i span_days:f t_min:i t_max:i", "interactions", """SELECT (SELECT count(*) FROM (SELECT src FROM interactions UNION SELECT dst FROM interactions)) AS nodes,
count(*) AS edges, round((max(ts) - min(ts)) / 86400.0, 2) AS span_days, min(ts) AS t_min, max(ts) AS t_max FROM interactions""")
def _(spark, d):
    e = c.interactions(spark, d)
    nodes = e.select("src").union(e.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return e.agg(F.count("*").alias("edges"), F.round((F.max("ts") - F.min("ts")) / 86_400, 2).alias("span_days"), F.min("ts").alias("t_min"), F.max("ts").alias("t_max")).join(nodes, how="cross")


@query("g2_adjacency", "node:i others:s", "reply_edges", SIMPLE + " SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS others FROM sym GROUP BY src")
def _(spark, d):
    a = graph.adjacency(sym(spark, d))
    return a.select("node", F.array_join("others", ",").alias("others"))


def pagerank_sql(n: int, edges: str = "reply_edges") -> str:
    """CTEs up to r{n}, the ranks after n rounds."""
    head = f"""e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {edges}),
nodes AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM nodes),
outs AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT node, 1.0 / n AS rank FROM nodes, n)"""
    for i in range(n):
        head += f""", r{i + 1} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM outs)) / n) AS rank
FROM n, nodes LEFT JOIN (SELECT e.dst, sum(r.rank / o.k) AS got FROM e JOIN r{i} r ON e.src = r.node JOIN outs o ON e.src = o.src GROUP BY e.dst) g ON nodes.node = g.dst)"""
    return head


@query("g4_pagerank", "node:i rank_milli:f", "reply_edges", pagerank_sql(20) + " SELECT node, 1000 * rank AS rank_milli FROM r20")
def _(spark, d):
    return graph.pagerank(c.reply_edges(spark, d), tolerance=1e-14).select("node", (1000 * F.col("rank")).alias("rank_milli"))


@query("g12_adamic_adar", "u:i v:i n:i adamic_adar:f", "reply_edges", SIMPLE + """,
deg AS (SELECT dst, count(*) AS d FROM sym GROUP BY dst HAVING count(*) > 1)
SELECT a.src AS u, b.src AS v, count(*) AS n, sum(1 / ln(d)) AS adamic_adar FROM sym a JOIN deg USING (dst) JOIN sym b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2""")
def _(spark, d):
    return graph.common_neighbours(sym(spark, d))


@query("g12_given_pairs", "u:i v:i n:i adamic_adar:f", "reply_edges", SIMPLE + """, deg AS (SELECT dst, count(*) AS d FROM sym GROUP BY dst), wanted AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM sym WHERE (src + dst) % 7 = 0),
got AS (SELECT u, v, count(*) AS n, sum(1 / ln(d)) AS aa FROM wanted JOIN sym a ON a.src = u JOIN sym b ON b.src = v AND b.dst = a.dst JOIN deg ON deg.dst = a.dst AND d > 1 GROUP BY 1, 2)
SELECT u, v, coalesce(n, 0) AS n, coalesce(aa, 0) AS adamic_adar FROM wanted LEFT JOIN got USING (u, v)""")
def _(spark, d):
    e = sym(spark, d)
    return graph.common_neighbours_of(e.filter("src < dst AND (src + dst) % 7 = 0").select(F.col("src").alias("u"), F.col("dst").alias("v")), e)


@query("g13_cascade_depth", "item_id:i node:i depth:i", "cascade_edges", """SELECT * FROM (WITH RECURSIVE t(item_id, node, depth) AS (
SELECT DISTINCT item_id, 0, 0 FROM cascade_edges UNION ALL SELECT e.item_id, e.child, t.depth + 1 FROM t JOIN cascade_edges e ON e.item_id = t.item_id AND e.parent = t.node) SELECT * FROM t)""")
def _(spark, d):
    return graph.cascade_depths(c.cascade_edges(spark, d))


FEATS = """f AS (SELECT account_id AS node, [avg(value), count(*) / 97.3, min(value) / 7.7] AS x FROM posts GROUP BY account_id),
fl AS (SELECT node, unnest([1, 2, 3]) AS pos, unnest(x) AS v FROM f), """ + SIMPLE


def feats(spark, d):
    return c.posts(spark, d).groupBy(F.col("account_id").alias("node")).agg(F.array(F.avg("value"), F.count("*") / 97.3, F.min("value") / 7.7).alias("x"))


def long(df):
    return df.select("node", F.posexplode("x").alias("p", "v")).select("node", (F.col("p") + 1).alias("pos"), "v")


for how in ("mean", "sum", "max"):
    sql = FEATS + f""" SELECT a.node, a.pos, coalesce(g.v, 0) AS v FROM fl a LEFT JOIN (
SELECT dst AS node, pos, {"avg" if how == "mean" else how}(v) AS v FROM sym JOIN fl ON src = node GROUP BY dst, pos) g ON a.node = g.node AND a.pos = g.pos"""

    @query(f"g16_scatter_{how}", "node:i pos:i v:f", "posts reply_edges", sql)
    def _(spark, d, how=how):
        return long(graph.scatter(feats(spark, d), sym(spark, d), how))


@query("g20_gcn", "node:i pos:i v:f", "posts reply_edges", FEATS + """,
dg AS (SELECT f.node, count(s.dst) AS d FROM f LEFT JOIN sym s ON s.dst = f.node GROUP BY f.node),
se AS (SELECT src, dst FROM sym UNION ALL SELECT node, node FROM f)
SELECT se.dst AS node, pos, sum(v / sqrt((a.d + 1) * (b.d + 1))) AS v FROM se JOIN fl ON se.src = fl.node JOIN dg a ON a.node = se.src JOIN dg b ON b.node = se.dst GROUP BY 1, 2""")
def _(spark, d):
    return long(graph.gcn(feats(spark, d), sym(spark, d)))


@query("g20_gcn_paper", "node:i pos:i v:f", "posts reply_edges", FEATS + """,
dg AS (SELECT f.node, count(s.dst) AS d FROM f LEFT JOIN sym s ON s.dst = f.node GROUP BY f.node),
se AS (SELECT src, dst FROM sym UNION ALL SELECT node, node FROM f)
SELECT se.dst AS node, pos, sum(v / greatest(b.d, 1)) AS v FROM se JOIN fl ON se.src = fl.node JOIN dg b ON b.node = se.dst GROUP BY 1, 2""")
def _(spark, d):
    return long(graph.gcn(feats(spark, d), sym(spark, d), "paper"))


W = [[0.5, -0.2], [0.1, 0.3], [-0.4, 0.25], [0.2, 0.2], [-0.1, 0.6], [0.3, -0.5]]
MEAN = FEATS + """, m AS (SELECT a.node, a.pos, a.v, coalesce(g.v, 0) AS m, coalesce(g.s, 0) AS s FROM fl a LEFT JOIN (
SELECT dst AS node, pos, avg(v) AS v, sum(v) AS s FROM sym JOIN fl ON src = node GROUP BY dst, pos) g ON a.node = g.node AND a.pos = g.pos),
wt AS (SELECT * FROM (VALUES """ + ", ".join(f"({i + 1}, {j + 1}, {x})" for i, r in enumerate(W) for j, x in enumerate(r)) + ") t(i, j, w))"


@query("g21_sage", "node:i pos:i v:f", "posts reply_edges", MEAN + " SELECT node, a.j AS pos, sum(v * a.w + m * b.w) AS v FROM m JOIN wt a ON a.i = pos JOIN wt b ON b.i = pos + 3 AND a.j = b.j GROUP BY 1, 2")
def _(spark, d):
    return long(graph.sage(feats(spark, d), sym(spark, d), W))


@query("g23_gin", "node:i pos:i v:f", "posts reply_edges", MEAN + " SELECT node, j AS pos, greatest(sum((1.1 * v + s) * w), 0) AS v FROM m JOIN wt ON i = pos GROUP BY 1, 2")
def _(spark, d):
    return long(graph.gin(feats(spark, d), sym(spark, d), 0.1, W[:3]))


@query("g24_gat", "node:i pos:i v:f", "posts reply_edges", FEATS + """,
own AS (SELECT node, x, 0.02 * x[1] + 0.1 * x[2] - 0.01 * x[3] AS s, -0.01 * x[1] + 0.2 * x[2] + 0.03 * x[3] AS r FROM f),
z AS (SELECT src, dst, CASE WHEN a.s + b.r > 0 THEN a.s + b.r ELSE 0.2 * (a.s + b.r) END AS z FROM sym JOIN own a ON src = a.node JOIN own b ON dst = b.node),
e AS (SELECT src, dst, exp(z - max(z) OVER (PARTITION BY dst)) AS e FROM z)
SELECT dst AS node, pos, sum(v * e) / sum(e) AS v FROM e JOIN fl ON src = node GROUP BY 1, 2""")
def _(spark, d):
    return long(graph.gat(feats(spark, d), sym(spark, d), [0.02, 0.1, -0.01], [-0.01, 0.2, 0.03]))


@query("g25_readout", "graph_id:i mean_value:f sum_value:f root_value:f", "cascade_nodes", """SELECT item_id AS graph_id, avg(value) AS mean_value, sum(value) AS sum_value, min_by(value, node) AS root_value FROM cascade_nodes GROUP BY 1""")
def _(spark, d):
    n = c.cascade_nodes(spark, d).select(F.col("item_id").alias("graph_id"), "node", F.array("value").alias("x"))
    out = graph.readout(n).select("graph_id", F.element_at("x", 1).alias("mean_value"))
    for how in ("sum", "root"):
        out = out.join(graph.readout(n, how).select("graph_id", F.element_at("x", 1).alias(f"{how}_value")), "graph_id")
    return out


@query("g7_attribute_graph", "src:i dst:i", "items", """a AS (SELECT item_id, "group" AS value, count(*) OVER (PARTITION BY "group") AS n FROM items),
h AS (SELECT item_id, value, round, substr(md5('group|' || value || '|' || round || '|' || item_id || '|0'), 1, 16) AS h FROM a, range(200) z(round) WHERE n > 200),
g AS (SELECT item_id AS src, coalesce(lead(item_id) OVER w, first(item_id) OVER w) AS dst FROM h WINDOW w AS (PARTITION BY value, round ORDER BY h, item_id))
SELECT x.item_id AS src, y.item_id AS dst FROM a x JOIN a y ON x.value = y.value AND x.item_id <> y.item_id WHERE x.n <= 200 UNION SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst""")
def _(spark, d):
    a = c.items(spark, d).select("item_id", F.lit("group").alias("attr"), F.col("group").alias("value"))
    return graph.attribute_pairs(a)


@query("g5_nearest", "id:i other:i sim:f r:i", "", """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
s AS (SELECT a.id, b.id AS other, round(list_inner_product(a.e, b.e), 9) AS sim FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS r FROM s) WHERE r <= 4""")
def _(spark, d):
    v = c.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return graph.nearest(v)
