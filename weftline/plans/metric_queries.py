"""Queries on splits, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.plans.base import query
from weftline.sources import canonical as c

DRAW = "('0x' || substr(md5({0} || '|{1}'), 1, 8))::UBIGINT / 4294967296.0"
AUC = """by_s AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scores GROUP BY score),
bl AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_s)"""
ROC = """by_s AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scores GROUP BY score),
roc AS (SELECT score, sum(n) OVER w / (SELECT sum(n) FROM by_s) AS fpr, sum(p) OVER w / (SELECT sum(p) FROM by_s) AS tpr FROM by_s WINDOW w AS (ORDER BY score DESC))"""


@query("t4_stratified", "item_id:i split:s", "items", f"""r AS (SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY {DRAW.format('item_id', 11)}, item_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM items WHERE label IS NOT NULL)
SELECT item_id, CASE WHEN r <= round_even(n * 0.2, 0) THEN 'test' WHEN r <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    return metrics.stratified(c.items(spark, d).filter("label IS NOT NULL"), "item_id", "label", 0.2, 0.1, seed=11)


@query("t5_group_split", "item_id:i split:s", "items", f"""g AS (SELECT DISTINCT "group" AS g FROM items), k AS (SELECT greatest(1, round_even(count(*) * 0.2, 0)) AS t, greatest(1, round_even(count(*) * 0.35, 0)) AS v FROM g),
r AS (SELECT g, row_number() OVER (ORDER BY {DRAW.format('g', 4)}, g) AS r FROM g)
SELECT item_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM items JOIN r ON "group" = g, k""")
def _(spark, d):
    return metrics.grouped_split(c.items(spark, d), "group", 0.2, 0.35, seed=4)


@query("t6_folds", "account_id:i fold:i", "posts accounts", f"SELECT account_id, (row_number() OVER (PARTITION BY label ORDER BY {DRAW.format('account_id', 9)}, account_id) - 1) % 5 AS fold FROM accounts")
def _(spark, d):
    return metrics.folds(c.accounts(spark, d), "account_id", "label", 5, seed=9)


@query("m8_binary_metrics", "tp:i fp:i fn:i tn:i precision:f recall:f f1:f accuracy:f auc:f", "scores", AUC + """,
k AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM scores)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) FROM bl) AS auc FROM k""")
def _(spark, d):
    s = c.scores(spark, d)
    return metrics.binary(s).join(metrics.auc(s), how="cross")


@query("m12_threshold_sweep", "t:f f1:f best:b", "scores", """s AS (SELECT t, 2.0 * count(*) FILTER (WHERE score >= t / 100.0 AND label = 1) / (count(*) FILTER (WHERE score >= t / 100.0) + count(*) FILTER (WHERE label = 1)) AS f1 FROM scores, range(5, 96) r(t) GROUP BY t)
SELECT t / 100.0 AS t, f1, t = (SELECT t FROM s ORDER BY round(f1, 9) DESC, t LIMIT 1) AS best FROM s""")
def _(spark, d):
    return metrics.threshold_sweep(c.scores(spark, d))


@query("w12_roc", "score:f fpr:f tpr:f", "scores", ROC + " SELECT * FROM roc")
def _(spark, d):
    return metrics.roc(c.scores(spark, d))


@query("m11_tpr_at_fpr", "tpr:f", "scores", ROC + """, x AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0 FROM roc)
SELECT max(t0 + (tpr - t0) * (0.01 - f0) / (fpr - f0)) AS tpr FROM x WHERE fpr > 0.01 AND f0 <= 0.01""")
def _(spark, d):
    return metrics.tpr_at(c.scores(spark, d))


@query("m9_classification", "label:s n:i precision:f recall:f f1:f", "", """p AS (SELECT lang AS y, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS q FROM documents), l AS (SELECT y AS l FROM p UNION SELECT q FROM p)
SELECT l AS label, count(*) FILTER (WHERE y = l) AS n, coalesce(count(*) FILTER (WHERE y = l AND q = l) / nullif(count(*) FILTER (WHERE q = l), 0), 0) AS precision, coalesce(count(*) FILTER (WHERE y = l AND q = l) / nullif(count(*) FILTER (WHERE y = l), 0), 0) AS recall,
2 * count(*) FILTER (WHERE y = l AND q = l) / (count(*) FILTER (WHERE y = l) + count(*) FILTER (WHERE q = l)) AS f1 FROM p, l GROUP BY l""")
def _(spark, d):
    x = c.table(spark, d, "documents").select(F.col("lang").alias("y"), F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")).alias("q"))
    return metrics.classification(x, "y", "q")


@query("m21_confusion", "y:s predicted:s n:i share:f", "", """p AS (SELECT lang AS y, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS q FROM documents), l AS (SELECT y AS l FROM p UNION SELECT q FROM p),
n AS (SELECT a.l AS y, b.l AS predicted, (SELECT count(*) FROM p WHERE p.y = a.l AND p.q = b.l) AS n FROM l a, l b)
SELECT *, n / sum(n) OVER (PARTITION BY y) AS share FROM n""")
def _(spark, d):
    x = c.table(spark, d, "documents").select(F.col("lang").alias("y"), F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")).alias("q"))
    return metrics.confusion(x, "y", "q")


@query("m13_separation", "feature:s separation:f", "posts accounts", """f AS (SELECT account_id, any_value(label) AS label, count(*)::DOUBLE AS n, avg(value) AS m, max(value) AS x FROM posts JOIN accounts USING (account_id) GROUP BY 1),
u AS (SELECT label, unnest(['n', 'm', 'x']) AS feature, unnest([n, m, x]) AS score FROM f), g AS (SELECT feature, score, sum(label) AS p, sum(1 - label) AS n FROM u GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT feature, abs(2 * sum(p * (below + n / 2)) / (sum(p) * sum(n)) - 1) AS separation FROM b GROUP BY feature""")
def _(spark, d):
    f = c.posts(spark, d).groupBy("account_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.max("value").alias("x")).join(c.accounts(spark, d), "account_id")
    u = f.selectExpr("label", "stack(3, 'n', n, 'm', m, 'x', x) AS (feature, score)")
    return metrics.auc(u, ["feature"]).select("feature", F.abs(2 * F.col("auc") - 1).alias("separation"))


@query("m14_paired_test", "n:i mean:f sd:f wins:i p:f significant:b clears:b", "posts", """g AS (SELECT avg(value) FILTER (WHERE post_id % 2 = 0) - avg(value) FILTER (WHERE post_id % 2 = 1) AS d FROM posts GROUP BY item_id % 16),
df AS (SELECT d FROM g WHERE d IS NOT NULL), k AS (SELECT d, (rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2) AS r FROM df WHERE d <> 0),
s AS (SELECT list(r) AS rs, sum(r) FILTER (WHERE d > 0) AS wp, sum(r) AS al, count(*) AS m FROM k),
t AS (SELECT least(1, 2 * count(*) / (1 << any_value(m))) AS p FROM s, range(1 << 16) z(id) WHERE id < (1 << m) AND list_sum(list_transform(rs, lambda x, i: ((id >> (i - 1)) & 1) * x)) <= least(wp, al - wp) + 1e-9)
SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, count(*) FILTER (WHERE d > 0) AS wins, any_value(p) AS p, any_value(p) < 0.05 AS significant, avg(d) > 0.02 AND any_value(p) < 0.05 AS clears FROM df, t""")
def _(spark, d):
    """Difference of mean event values between even and odd posts, by item group: 16 pairs at most."""
    p = c.posts(spark, d).groupBy((F.col("item_id") % 16).alias("g")).agg(F.avg(F.when(F.col("post_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("post_id") % 2 == 1, F.col("value"))).alias("b"))
    return metrics.paired(p.select((F.col("a") - F.col("b")).alias("d")).filter("d IS NOT NULL"))


@query("m9_averages", "n:i accuracy:f macro_f1:f micro_f1:f majority:f", "", """p AS (SELECT lang AS y, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS q FROM documents), l AS (SELECT y AS l FROM p UNION SELECT q FROM p),
f AS (SELECT l, 2 * count(*) FILTER (WHERE y = l AND q = l) / (count(*) FILTER (WHERE y = l) + count(*) FILTER (WHERE q = l)) AS f1, count(*) FILTER (WHERE y = l) AS n FROM p, l GROUP BY l)
SELECT (SELECT count(*) FROM p) AS n, (SELECT avg((y = q)::INTEGER) FROM p) AS accuracy, avg(f1) AS macro_f1, (SELECT avg((y = q)::INTEGER) FROM p) AS micro_f1, max(n) / sum(n) AS majority FROM f""")
def _(spark, d):
    x = c.table(spark, d, "documents").select(F.col("lang").alias("y"), F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")).alias("q"))
    return metrics.multiclass(x, "y", "q")


@query("m9_one_vs_rest", "auc:f", "", """s AS (SELECT doc_id, lang AS label, c.lang AS class, (doc_id * 31 + ascii(c.lang) * 7) % 97 / 97.0 + CASE WHEN d.lang = c.lang THEN 0.3 ELSE 0 END AS score FROM documents d, (SELECT DISTINCT lang FROM documents) c),
g AS (SELECT class, score, sum((label = class)::INTEGER) AS p, sum((label <> class)::INTEGER) AS n FROM s GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT avg(a) AS auc FROM (SELECT class, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS a FROM b GROUP BY class)""".replace("doc_id, lang AS label", "doc_id, d.lang AS label"))
def _(spark, d):
    docs = c.table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    classes = docs.select(F.col("label").alias("class")).distinct()
    score = (F.col("doc_id") * 31 + F.ascii("class") * 7) % 97 / 97.0 + F.when(F.col("label") == F.col("class"), 0.3).otherwise(0.0)
    return metrics.one_vs_rest_auc(docs.join(F.broadcast(classes), how="cross").select("label", "class", score.alias("score")))  # a row a language


@query("m1_min_max", "c_custkey:i c_acctbal:f", "", "SELECT c_custkey, (c_acctbal - lo) / (hi - lo) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def _(spark, d):
    return metrics.min_max(c.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("m2_z_score", "c_custkey:i c_acctbal:f", "", "SELECT c_custkey, (c_acctbal - m) / s AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def _(spark, d):
    return metrics.z_score(c.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("a10_majority", "label:i n:i share:f", "posts accounts", "SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM accounts) AS share FROM accounts GROUP BY label ORDER BY n DESC, label LIMIT 1")
def _(spark, d):
    a = c.accounts(spark, d)
    total = a.agg(F.count("*").alias("all"))
    return a.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).join(total, how="cross").withColumn("share", F.col("n") / F.col("all"))


@query("a11_class_balance", "grp:s label:i n:i", "items", 'SELECT "group" AS grp, label, count(*) AS n FROM items WHERE label IS NOT NULL GROUP BY GROUPING SETS (("group", label), (label))')
def _(spark, d):
    i = c.items(spark, d).filter("label IS NOT NULL").withColumnRenamed("group", "grp")
    return i.groupingSets([["grp", "label"], ["label"]], "grp", "label").agg(F.count("*").alias("n"))


@query("a21_summaries", "event_type:s mean:f sd0:f sd1:f lo:f hi:f", "posts", "SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sd0, stddev_samp(value) AS sd1, min(value) AS lo, max(value) AS hi FROM posts GROUP BY 1")
def _(spark, d):
    return c.posts(spark, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd0"), F.stddev_samp("value").alias("sd1"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("a23_partial_correlation", "r_xy:f r_xy_z:f", "", """r AS (SELECT corr(l_extendedprice, l_quantity) AS xy, corr(l_extendedprice, l_discount) AS xz, corr(l_quantity, l_discount) AS yz FROM lineitem)
SELECT xy AS r_xy, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r_xy_z FROM r""")
def _(spark, d):
    return metrics.partial_correlation(c.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
