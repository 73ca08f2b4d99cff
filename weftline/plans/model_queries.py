"""Queries on fitted models and their protocols; the parts that aren't fitted are held to SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.lineage import written
from weftline.functions.scalars import draw
from weftline.operators import builders, decomposition, models, protocols, sampling, series, similar, temporal, text
from weftline.plans.base import query
from weftline.plans.building_queries import long_nodes, tree
from weftline.plans.graph_queries import INTER, SIMPLE, feats, inter, pagerank_sql, sym
from weftline.plans.sampling_queries import RATIO_SQL
from weftline.plans.series_queries import GAPS
from weftline.sources import canonical as c

DRAW = "('0x' || substr(md5({0} || '|{1}'), 1, 8))::UBIGINT / 4294967296.0"


def rows(spark, d):
    """[id, label, blocks]: accounts with two blocks of features."""
    p = c.posts(spark, d).groupBy("account_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.max("value").alias("x"), F.stddev_pop("value").alias("s"))
    made = p.join(c.accounts(spark, d), "account_id")
    return made.select(F.col("account_id").alias("id"), "label", F.struct(F.array(F.log1p("n"), F.col("m") + F.col("label") * 3).alias("count"), F.array("x", "s").alias("value")).alias("blocks"))


def fit_rows(spark, d):
    return models.blocks(rows(spark, d), ["count", "value"])


for kind, number in (("svm", "m3"), ("boosted", "m4"), ("logistic", "m4"), ("network", "m5")):

    @query(f"{number}_{kind}", "id:i label:i fold:i score:f predicted:i")
    def _(spark, d, kind=kind):
        return models.out_of_fold(fit_rows(spark, d), kind, 3, seed=2, rounds=10)


@query("m6_link_predictor", "u:i v:i label:i score:f predicted:i")
def _(spark, d):
    s = temporal.link_samples(c.reply_edges(spark, d), new_only=False, seed=3)
    return models.link_predictor(s.filter("split = 'train'"), s.filter("split = 'test'"), feats(spark, d))


@query("m7_node_classifier", "id:i label:i score:f predicted:i")
def _(spark, d):
    labels = c.accounts(spark, d).select(F.col("account_id").alias("node"), "label", F.when(F.col("account_id") % 4 == 0, "test").otherwise("train").alias("split"))
    return models.node_classifier(feats(spark, d), sym(spark, d), labels)


@query("m7_graph_classifier", "id:i label:i score:f predicted:i")
def _(spark, d):
    n, e = builders.propagation_graph(**tree(spark, d))
    labels = n.select("graph_id").distinct().select("graph_id", (F.col("graph_id") % 3 == 0).cast("int").alias("label"), F.when(F.col("graph_id") % 4 == 1, "test").otherwise("train").alias("split"))
    return models.graph_classifier(n, e, labels)


PRED = f"pr AS (SELECT id, label, score, (score >= 0.5)::INTEGER AS predicted, floor({DRAW.format('id', 33)} * 5)::INTEGER AS fold FROM scores)"
BY_FOLD = """k AS (SELECT fold, count(*) FILTER (WHERE predicted = 1 AND label = 1) AS tp, count(*) FILTER (WHERE predicted = 1 AND label = 0) AS fp, count(*) FILTER (WHERE predicted = 0 AND label = 1) AS fn, count(*) FILTER (WHERE predicted = 0 AND label = 0) AS tn FROM pr GROUP BY fold),
m AS (SELECT fold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM k)"""


def predictions(spark, d):
    return c.scores(spark, d).select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.floor(draw("id", seed=33) * 5).cast("int").alias("fold"))


@query("m10_fold_metrics", "fold:i accuracy:f f1:f precision:f recall:f", "scores", f"{PRED}, {BY_FOLD} SELECT * FROM m")
def _(spark, d):
    return models.fold_metrics(predictions(spark, d), ["fold"])


@query("m10_summary", "metric:s mean:f sd:f lo:f hi:f", "scores", f"{PRED}, {BY_FOLD}, u AS (SELECT unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric, unnest([accuracy, f1, precision, recall]) AS v FROM m) SELECT metric, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1")
def _(spark, d):
    return models.summary(models.fold_metrics(predictions(spark, d), ["fold"]), [], ["accuracy", "f1", "precision", "recall"])


@query("m15_arms", "arm:s seed:i id:i label:i fold:i score:f predicted:i")
def _(spark, d):
    return models.arms(rows(spark, d), {"COUNT": ["count"], "COUNT+VALUE": ["count", "value"]}, ["logistic"], [1, 2], 3)


@query("m17_compared", "arm:s seed:i auc:f accuracy:f f1:f precision:f recall:f", "scores", """a AS (SELECT 'plain' AS arm, id % 2 AS seed, label, score FROM scores UNION ALL SELECT 'squared', id % 2, label, score * score FROM scores),
k AS (SELECT arm, seed, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM a GROUP BY 1, 2),
g AS (SELECT arm, seed, score, sum(label) AS p, sum(1 - label) AS n FROM a GROUP BY 1, 2, 3), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY arm, seed ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
u AS (SELECT arm, seed, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM b GROUP BY 1, 2)
SELECT arm, seed, auc, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM k JOIN u USING (arm, seed)""")
def _(spark, d):
    s = c.scores(spark, d).withColumn("seed", F.col("id") % 2)
    both = s.withColumn("arm", F.lit("plain")).unionByName(s.withColumn("arm", F.lit("squared")).withColumn("score", F.col("score") * F.col("score")))
    return models.compared(both.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


BLOCKS = "bl AS (SELECT account_id AS id, [ln(1 + count(*)), avg(value) + any_value(label) * 3] AS c, [max(value), stddev_pop(value)] AS v FROM posts JOIN accounts USING (account_id) GROUP BY 1)"


@query("m18_ablations", "variant:s id:i c1:f v2:f", "posts accounts", BLOCKS + " SELECT 'all' AS variant, id, c[1] AS c1, v[2] AS v2 FROM bl UNION ALL SELECT 'no count', id, 0, v[2] FROM bl UNION ALL SELECT 'no value', id, c[1], 0 FROM bl")
def _(spark, d):
    return models.ablations(rows(spark, d), ["count", "value"]).select("variant", "id", F.element_at("blocks.count", 1).alias("c1"), F.element_at("blocks.value", 2).alias("v2"))


@query("m18_only_one", "variant:s id:i c1:f v2:f", "posts accounts", BLOCKS + " SELECT 'all' AS variant, id, c[1] AS c1, v[2] AS v2 FROM bl UNION ALL SELECT 'only count', id, c[1], 0 FROM bl UNION ALL SELECT 'only value', id, 0, v[2] FROM bl")
def _(spark, d):
    return models.ablations(rows(spark, d), ["count", "value"], only=True).select("variant", "id", F.element_at("blocks.count", 1).alias("c1"), F.element_at("blocks.value", 2).alias("v2"))


@query("m19_suite", "suite:s variant:s id:i label:i score:f predicted:i")
def _(spark, d):
    return models.suite("cost", {f"C={x}": (lambda x=x: models.out_of_fold(fit_rows(spark, d), "logistic", 2, cost=x)) for x in (0.1, 10.0)})


DAY = 86_400


@query("m17_methods", "arm:s seed:i auc:f accuracy:f f1:f precision:f recall:f")
def _(spark, d):
    """Five methods of node features on one link task of replies."""
    walking = {"num_walks": 2, "length": 8, "size": 16, "window": 3}
    methods = {"degree": {}, "pagerank": {}, "static_entropy": {}, "walks": walking, "time_weighted": walking}
    return protocols.compare_methods(c.reply_edges(spark, d), methods, (3,), DAY, {"new_only": False})


@query("m16_window_entropy", "window_seconds:i node:i lne_last:f lne_tw:f", "reply_edges", """g AS (SELECT unnest([43200, 86400, 604800]) AS window_seconds), t0 AS (SELECT min(ts) AS t0 FROM reply_edges),
snaps AS (SELECT DISTINCT window_seconds, (ts - t0) // window_seconds AS w, least(src, dst) AS u, greatest(src, dst) AS v FROM reply_edges, t0, g),
nb AS (SELECT window_seconds, w, u AS node, v AS other FROM snaps UNION ALL SELECT window_seconds, w, v, u FROM snaps WHERE u <> v),
dg AS (SELECT window_seconds, w, node, sum(CASE WHEN node = other THEN 2 ELSE 1 END) AS deg FROM nb GROUP BY ALL),
lne AS (SELECT nb.window_seconds, nb.w, nb.node, (ln(sum(pow(d.deg, 0.6))) - 0.6 * ln(sum(d.deg))) / 0.4 AS h FROM nb JOIN dg d ON nb.window_seconds = d.window_seconds AND nb.w = d.w AND nb.other = d.node GROUP BY ALL),
t AS (SELECT window_seconds, max(w) AS top FROM snaps GROUP BY 1)
SELECT window_seconds, node, sum(CASE WHEN w = top THEN h ELSE 0 END) AS lne_last, sum(exp(-1.2 * (top - w)) * h) AS lne_tw FROM lne JOIN t USING (window_seconds) GROUP BY 1, 2""")
def _(spark, d):
    return protocols.window_entropy(c.reply_edges(spark, d), [DAY // 2, DAY, 7 * DAY])


@query("m16_ratio_samples", "ratio:f split:s u:i v:i label:i", "interactions", RATIO_SQL)
def _(spark, d):
    return protocols.ratio_samples(c.interactions(spark, d), [0.25, 1.0], seed=21, new_only=False)


@query("m16_window_sweep", "arm:s metric:s mean:f sd:f lo:f hi:f")
def _(spark, d):
    return protocols.window_sweep(c.reply_edges(spark, d), [DAY, 7 * DAY], (3,), {"new_only": False})


@query("m16_ratio_sweep", "arm:s metric:s mean:f sd:f lo:f hi:f")
def _(spark, d):
    return protocols.ratio_sweep(c.reply_edges(spark, d), [0.5, 1.0], feats(spark, d), (3,), {"new_only": False})


@query("m18_ablation_metrics", "arm:s seed:i auc:f accuracy:f f1:f precision:f recall:f loss:f")
def _(spark, d):
    return protocols.block_ablation(rows(spark, d), ["count", "value"], k=3, seeds=(2,))


@query("m18_single_blocks", "arm:s seed:i auc:f accuracy:f f1:f precision:f recall:f loss:f")
def _(spark, d):
    return protocols.block_ablation(rows(spark, d), ["count", "value"], k=3, seeds=(2,), only=True)


@query("m19_node_suites", "suite:s variant:s seed:i auc:f accuracy:f f1:f precision:f recall:f")
def _(spark, d):
    """Accounts with features, joined by replies or by the items they share; every ninth has no label."""
    a = c.accounts(spark, d).select(F.col("account_id").alias("node"), F.when(F.col("account_id") % 9 != 4, F.col("label")).alias("label"), (F.col("account_id") % 6).alias("part"))
    x = written(fit_rows(spark, d).select(F.col("id").alias("node"), "x"))
    near = similar.nearest_pairs(similar.unit_vectors(x.select(F.col("node").alias("id"), F.col("x").alias("vec"))), 4).select("src", "dst")
    return protocols.node_suites(a.join(x, "node"), {"replies": written(sym(spark, d)), "nearest": written(temporal.to_undirected(near))}, "part", (1,))


@query("m20_tidy", "run_id:s mean:f top:f", "posts", "SELECT event_type AS run_id, round(avg(value), 4) AS mean, round(max(value), 4) AS top FROM posts GROUP BY 1")
def _(spark, d):
    by = c.posts(spark, d).groupBy(F.col("event_type").alias("run_id")).agg(F.avg("value").alias("mean"), F.max("value").alias("top"))
    return models.tidy(by.select("run_id", F.explode(F.create_map(F.lit("mean"), "mean", F.lit("top"), "top")).alias("metric", "value")))


@query("x3_assembled", "id:i split:s block:s pos:i v:f", "posts accounts", BLOCKS + """, ln AS (SELECT id, CASE WHEN id % 4 = 1 THEN 'test' ELSE 'train' END AS split, 'count' AS block, unnest([1, 2]) AS pos, unnest(c) AS v FROM bl UNION ALL SELECT id, CASE WHEN id % 4 = 1 THEN 'test' ELSE 'train' END, 'value', unnest([1, 2]), unnest(v) FROM bl),
st AS (SELECT block, pos, avg(v) AS m, stddev_pop(v) AS s FROM ln WHERE split = 'train' GROUP BY 1, 2) SELECT id, split, block, pos, coalesce((v - m) / nullif(s, 0), 0) AS v FROM ln JOIN st USING (block, pos)""")
def _(spark, d):
    x = models.assembled(rows(spark, d).withColumn("split", F.when(F.col("id") % 4 == 1, "test").otherwise("train")), ["count", "value"])
    both = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"blocks.{b}").alias("x")) for b in ("count", "value")])).alias("b")
    return long_nodes(x.select("id", "split", both).select("id", "split", "b.block", "b.x"))


ALPHAS, LAMS = [0.2, 0.6, 1.0, 2.0], [0.4, 1.2]


@query("m16_entropy_sweep", "alpha:f lam:f node:i lne_tw:f", "interactions", INTER + ", hh AS (SELECT nb.w, nb.node, al AS alpha, CASE WHEN al = 1 THEN ln(sum(d.deg)) - sum(d.deg * ln(d.deg)) / sum(d.deg) ELSE (ln(sum(pow(d.deg, al))) - al * ln(sum(d.deg))) / (1 - al) END AS hx FROM nb JOIN prob d ON nb.w = d.w AND nb.other = d.node, (SELECT unnest([0.2, 0.6, 1.0, 2.0]::DOUBLE[]) AS al) GROUP BY 1, 2, 3), t AS (SELECT max(w) AS top FROM snaps) SELECT alpha, lam, node, sum(exp(-lam * (top - w)) * hx) AS lne_tw FROM hh, t, (SELECT unnest([0.4, 1.2]::DOUBLE[]) AS lam) GROUP BY 1, 2, 3")
def _(spark, d):
    return models.sweep(inter(spark, d), ALPHAS, LAMS)


GRID = [(12, 86_400_000.0), (24, 400 * 86_400_000.0)]


@query("m16_binning_sweep", "n_bins:i hi:f account_id:i H_1:f", "posts", GAPS + f", gr AS (SELECT * FROM (VALUES (12, 86400000.0::DOUBLE), (24, {400 * 86_400_000.0}::DOUBLE)) t(n_bins, hi)), b AS (SELECT n_bins, hi, account_id, CASE WHEN dt <= 0 THEN 0 WHEN dt >= 1 AND dt <= hi THEN len(list_filter(range(n_bins), lambda i: pow(hi, i / n_bins) <= dt)) END AS bin FROM gp, gr), k AS (SELECT n_bins, hi, account_id, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL) SELECT n_bins, hi, account_id, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2) AS H_1 FROM k GROUP BY 1, 2, 3")
def _(spark, d):
    return models.binning_sweep(series.gaps(c.posts(spark, d)), GRID)


@query("m22_plane", "id:i a:f b:f")
def _(spark, d):
    x = fit_rows(spark, d)
    return models.plane(x.filter("id % 4 <> 1"), x).select("id", F.element_at("pc", 1).alias("a"), F.element_at("pc", 2).alias("b"))


@query("a16_gap", "centred_norm:f class_gap:f", "", """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label < 2), m AS (SELECT pos, avg(v) AS m FROM e GROUP BY 1),
n AS (SELECT avg(n) AS centred_norm FROM (SELECT sqrt(sum((v - m) * (v - m))) AS n FROM e JOIN m USING (pos) GROUP BY vec_id)),
g AS (SELECT avg(abs(m0 - m1) / sqrt((s0 + s1) / 2)) AS class_gap FROM (SELECT avg(v) FILTER (WHERE label = 0) AS m0, avg(v) FILTER (WHERE label = 1) AS m1, var_pop(v) FILTER (WHERE label = 0) AS s0, var_pop(v) FILTER (WHERE label = 1) AS s1 FROM e GROUP BY pos)) SELECT * FROM n, g""")
def _(spark, d):
    e = c.table(spark, d, "embeddings").filter("label < 2")
    return models.vector_diagnostics(e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x")))


@query("a16_components", "components:i")
def _(spark, d):
    return models.explained(c.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")))


@query("a17_singular_spectrum", "i:i sigma:f")
def _(spark, d):
    from weftline.operators.passing import random_projection

    return decomposition.singular_spectrum(random_projection(feats(spark, d), sym(spark, d), 4, seed=3))


@query("x2_truncated_svd", "item_id:i pos:i v:f")
def _(spark, d):
    t = c.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "text", "conv_id")
    w = text.tf_idf(t, F.col("conv_id") % 5 != 0, max_features=300)
    return long_nodes(decomposition.truncated_svd(w.filter("item_id div 100 % 5 <> 0"), w, "item_id", 16))


@query("x5_token_means", "post:i pos:i v:f", "", "SELECT vec_id // 4 AS post, pos, coalesce(avg(v) FILTER (WHERE vec_id % 4 <> 3 AND vec_id // 4 % 9 <> 5), 0) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def _(spark, d):
    k = F.col("vec_id")
    post = F.floor(k / 4)
    t = c.table(spark, d, "embeddings").select(post.alias("post"), (k % 4).alias("token_pos"), F.col("embedding").cast("array<double>").alias("vec"), F.when((k % 4 == 3) | (post % 9 == 5), 0).otherwise(1).alias("mask"))
    return long_nodes(models.token_means(t).select("post", "x"))


@query("x5_first_token", "post:i v:f", "", "SELECT vec_id // 4 AS post, min_by(embedding[1], vec_id)::DOUBLE AS v FROM embeddings GROUP BY 1")
def _(spark, d):
    k = F.col("vec_id")
    t = c.table(spark, d, "embeddings").select(F.floor(k / 4).alias("post"), (k % 4).alias("token_pos"), F.col("embedding").cast("array<double>").alias("vec"), F.lit(1).alias("mask"))
    return models.token_means(t, first_only=True).select("post", F.element_at("x", 1).alias("v"))


def _lengths():
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("x6_encoded", "doc_id:i chars:f blanks:f", "", "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents")
def _(spark, d):
    x = models.encoded(c.table(spark, d, "documents").select("doc_id", "text"), _lengths)
    return x.select("doc_id", F.element_at("vec", 1).alias("chars"), F.element_at("vec", 2).alias("blanks"))


@query("x8_node_vectors", "node:s pos:i v:f")
def _(spark, d):
    walks = sampling.random_walks(sym(spark, d), 2, 8, seed=14)
    return long_nodes(models.node_vectors(walks, 16, 3))


@query("x9_joined_vectors", "node:i pos:i v:f", "posts", "f AS (SELECT account_id AS node, [avg(value), max(value)] AS g FROM posts GROUP BY 1), e AS (SELECT vec_id AS node, embedding[1:3] AS t FROM embeddings), b AS (SELECT node, coalesce(g, [0, 0]) || coalesce(list_transform(t, lambda x: x::DOUBLE), [0, 0, 0]) AS x FROM f FULL JOIN e USING (node)) SELECT node, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM b")
def _(spark, d):
    g = c.posts(spark, d).groupBy(F.col("account_id").alias("node")).agg(F.array(F.avg("value"), F.max("value")).alias("x"))
    t = c.table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("x"))
    return long_nodes(models.joined_vectors(g, t, "node", 2, 3))


@query("x10_entropy_block", "node:i pos:i v:f", "interactions", INTER + """, t AS (SELECT max(w) AS top FROM snaps), fe AS (SELECT node, [sum(CASE WHEN w = top THEN h ELSE 0 END), sum(exp(-1.2 * (top - w)) * h), 1] AS x FROM lne, t GROUP BY node),
fl AS (SELECT node, unnest(x) AS v, unnest([1, 2, 3]) AS pos FROM fe) SELECT node, pos, coalesce((v - min(v) OVER (PARTITION BY pos)) / nullif(max(v) OVER (PARTITION BY pos) - min(v) OVER (PARTITION BY pos), 0), 0) AS v FROM fl""")
def _(spark, d):
    return long_nodes(models.node_features("entropy", c.interactions(spark, d)))


@query("x10_degree", "node:i pos:i v:f", "reply_edges", "sy AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM reply_edges UNION ALL SELECT dst, src FROM reply_edges) WHERE src <> dst), dg AS (SELECT dst AS node, count(*) AS k FROM sy GROUP BY 1) SELECT node, 1 AS pos, coalesce((k - min(k) OVER ()) / nullif(max(k) OVER () - min(k) OVER (), 0), 0) AS v FROM dg")
def _(spark, d):
    return long_nodes(models.node_features("degree", c.reply_edges(spark, d)))


SCALED = " SELECT node, 1 AS pos, coalesce((k - min(k) OVER ()) / nullif(max(k) OVER () - min(k) OVER (), 0), 0) AS v FROM dg"


@query("x10_static_entropy", "node:i pos:i v:f", "reply_edges", SIMPLE + """, deg AS (SELECT src AS node, count(*) AS deg FROM sym GROUP BY src),
dg AS (SELECT s.src AS node, (ln(sum(pow(d.deg, 0.6))) - 0.6 * ln(sum(d.deg))) / 0.4 AS k FROM sym s JOIN deg d ON s.dst = d.node GROUP BY s.src)""" + SCALED)
def _(spark, d):
    return long_nodes(models.node_features("static_entropy", c.reply_edges(spark, d)))


@query("x10_pagerank", "node:i pos:i v:f", "reply_edges", SIMPLE + ", " + pagerank_sql(40, "sym") + ", dg AS (SELECT node, rank AS k FROM r40)" + SCALED)
def _(spark, d):
    return long_nodes(models.node_features("pagerank", c.reply_edges(spark, d), tolerance=1e-14))
