"""Queries on account event series and cascades in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.scalars import has_time, id_time_ms, ratio
from weftline.operators import graph, series
from weftline.plans.base import query
from weftline.sources import canonical as c

GAPS = "g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY account_id ORDER BY ts_ms, post_id) AS dt FROM posts), gp AS (SELECT * FROM g WHERE dt IS NOT NULL)"
BURST = GAPS + """, x AS (SELECT account_id, dt / 3600000.0 AS a, lead(dt / 3600000.0) OVER (PARTITION BY account_id ORDER BY ts_ms, post_id) AS b FROM gp),
one AS (SELECT account_id, count(*) AS n_gaps, avg(a) AS m, stddev_pop(a) AS s FROM x GROUP BY 1),
pr AS (SELECT account_id, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM x WHERE b IS NOT NULL GROUP BY 1),
cv AS (SELECT account_id, avg((a - ma) * (b - mb)) AS cov, any_value(sa) AS sa, any_value(sb) AS sb FROM x JOIN pr USING (account_id) WHERE b IS NOT NULL GROUP BY 1),
bursts AS (SELECT account_id, n_gaps, CASE WHEN n_gaps >= 2 AND s + m <> 0 THEN (s - m) / (s + m) ELSE 0 END AS burstiness, CASE WHEN n_gaps >= 2 AND m <> 0 THEN s / m ELSE 0 END AS cv,
  CASE WHEN n_gaps >= 3 AND sa * sb <> 0 THEN cov / (sa * sb) ELSE 0 END AS memory FROM one LEFT JOIN cv USING (account_id))"""
HI = 400 * 86_400_000.0
EDGES = "[" + ", ".join(repr(HI ** (i / 24)) for i in range(24)) + "]"
BINS = f"""lb AS (SELECT account_id, CASE WHEN dt <= 0 THEN 0 WHEN dt >= 1 AND dt <= {HI} THEN len(list_filter({EDGES}, lambda e: e <= dt)) END AS bin FROM gp),
bins AS (SELECT account_id, bin, count(*) AS n FROM lb WHERE bin IS NOT NULL GROUP BY 1, 2)"""
HOURS = "hours AS (SELECT account_id, (ts_ms % 86400000) // 3600000 AS bin, count(*) AS n FROM posts GROUP BY 1, 2)"


def spectrum_sql(source: str, prefix: str = "") -> str:
    power = lambda a: f"(ln(sum(pow(n, {a}))) - {a} * ln(sum(n))) / {1 - a} / ln(2)"
    return f"""SELECT account_id, ln(count(*)) / ln(2) AS {prefix}H_0, {power(0.5)} AS {prefix}H_0_5, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2) AS {prefix}H_1,
{power(2.0)} AS {prefix}H_2, {power(4.0)} AS {prefix}H_4, (ln(sum(n)) - ln(max(n))) / ln(2) AS {prefix}H_inf FROM {source} GROUP BY account_id"""


H = "H_0:f H_0_5:f H_1:f H_2:f H_4:f H_inf:f"


@query("f3_decoded_ids", "post_id:i ts_ms:i", "posts", "SELECT post_id, (tweet_id >> 22) + 1288834974657 AS ts_ms FROM posts WHERE tweet_id >= 29700859247")
def _(spark, d):
    return c.posts(spark, d).filter(has_time(F.col("tweet_id"))).select("post_id", id_time_ms(F.col("tweet_id")).alias("ts_ms"))


@query("a8_dropped_ids", "label:i dropped:i accounts:i", "posts accounts", "SELECT label, count(*) AS dropped, count(DISTINCT account_id) AS accounts FROM posts JOIN accounts USING (account_id) WHERE tweet_id < 29700859247 GROUP BY label")
def _(spark, d):
    p = c.posts(spark, d).filter(~has_time(F.col("tweet_id"))).groupBy("account_id").agg(F.count("*").alias("n"))
    return p.join(c.accounts(spark, d), "account_id").groupBy("label").agg(F.sum("n").alias("dropped"), F.count("*").alias("accounts"))


@query("w1_gaps", "post_id:i dt:i", "posts", GAPS + " SELECT post_id, dt FROM gp")
def _(spark, d):
    return series.gaps(c.posts(spark, d))


@query("a3_burstiness", "account_id:i n_gaps:i burstiness:f cv:f memory:f", "posts", BURST + " SELECT * FROM bursts")
def _(spark, d):
    return series.bursts(series.gaps(c.posts(spark, d)))


@query("e5_log_bins", "account_id:i bin:i n:i", "posts", f"{GAPS}, {BINS} SELECT * FROM bins")
def _(spark, d):
    return series.log_bins(series.gaps(c.posts(spark, d)), "account_id")


@query("e6_hours", "account_id:i bin:i n:i", "posts", HOURS + " SELECT * FROM hours")
def _(spark, d):
    return series.hours(c.posts(spark, d))


@query("e3_hour_spectrum", "account_id:i " + H, "posts", f"{HOURS} {spectrum_sql('hours')}")
def _(spark, d):
    return series.spectrum(series.hours(c.posts(spark, d)), "account_id")


@query("e13_temporal_blocks", "account_id:i count:f burstiness:f cv:f memory:f " + " ".join(f"{p}{x}" for p in ("gap_", "hour_") for x in H.split()), "posts",
       f"{BURST}, {BINS}, {HOURS}, sg AS ({spectrum_sql('bins', 'gap_')}), sh AS ({spectrum_sql('hours', 'hour_')}), ct AS (SELECT account_id, ln(1 + count(*)) AS count FROM posts GROUP BY 1 HAVING count(*) >= 5) SELECT ct.*, burstiness, cv, memory, " + ", ".join(f"coalesce({p}{x.split(':')[0]}, 0) AS {p}{x.split(':')[0]}" for p in ("gap_", "hour_") for x in H.split()) + " FROM ct JOIN bursts USING (account_id) LEFT JOIN sg USING (account_id) LEFT JOIN sh USING (account_id)")
def _(spark, d):
    return series.temporal_blocks(c.posts(spark, d))


@query("e13_kept_counts", "label:i kept:i excluded:i", "posts accounts", "SELECT label, count(*) FILTER (WHERE n >= 40) AS kept, count(*) FILTER (WHERE n IS NULL OR n < 40) AS excluded FROM accounts LEFT JOIN (SELECT account_id, count(*) AS n FROM posts GROUP BY 1) USING (account_id) GROUP BY label")
def _(spark, d):
    return series.kept_counts(c.posts(spark, d), c.accounts(spark, d), 40)


@query("a2_event_counts", "account_id:i n:i", "posts accounts", "SELECT account_id, count(post_id) AS n FROM accounts LEFT JOIN posts USING (account_id) GROUP BY 1")
def _(spark, d):
    n = c.posts(spark, d).groupBy("account_id").agg(F.count("*").alias("n"))
    return c.accounts(spark, d).join(n, "account_id", "left").select("account_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("a6_age_violations", "checked:i violations:i fraction:f accounts_with_any:i accounts_with_events:i worst_days:f max_per_account:i", "posts accounts", """o AS (
SELECT account_id, count(*) AS c, count(*) FILTER (WHERE ts_ms < created_ms) AS v, max(created_ms - ts_ms) FILTER (WHERE ts_ms < created_ms) AS worst FROM posts JOIN accounts USING (account_id) GROUP BY 1)
SELECT sum(c) AS checked, sum(v) AS violations, sum(v) / sum(c) AS fraction, count(*) FILTER (WHERE v > 0) AS accounts_with_any, count(*) AS accounts_with_events, max(worst) / 86400000.0 AS worst_days, max(v) AS max_per_account FROM o""")
def _(spark, d):
    return series.age_violations(c.posts(spark, d), c.accounts(spark, d))


@query("a7_retention", "min_events:i label:i kept:i share:f", "posts accounts", """n AS (SELECT account_id, any_value(label) AS label, count(post_id) AS n FROM accounts LEFT JOIN posts USING (account_id) GROUP BY 1)
SELECT min_events, label, sum(CASE WHEN n >= min_events THEN 1 ELSE 0 END) AS kept, avg(CASE WHEN n >= min_events THEN 1 ELSE 0 END) AS share
FROM n, (SELECT unnest([32, 64, 128, 256, 512]) AS min_events) GROUP BY ROLLUP (min_events, label) HAVING min_events IS NOT NULL""")
def _(spark, d):
    return series.retention(c.posts(spark, d), c.accounts(spark, d), [32, 64, 128, 256, 512])


@query("a9_type_shares", "event_type:s n:i share:f", "posts", "SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM posts GROUP BY 1")
def _(spark, d):
    n = c.posts(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.join(F.broadcast(total), how="cross").select("event_type", "n", ratio(F.col("n"), F.col("all")).alias("share"))  # one row


@query("w3_counter_null", "post_id:i null_ts:i", "posts", """SELECT post_id, lo + floor((row_number() OVER (ORDER BY ts_ms, post_id) - 1) * (hi - lo) / (n - 1))::BIGINT AS null_ts
FROM posts, (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi, count(*) AS n FROM posts)""")
def _(spark, d):
    return series.counter_null(c.posts(spark, d))


@query("e15_hour_profile", "tv:f peak_trough:f", "posts", """h AS (SELECT b, count(post_id) AS n FROM range(24) r(b) LEFT JOIN posts ON (ts_ms % 86400000) // 3600000 = b GROUP BY b)
SELECT 0.5 * sum(abs(n / (SELECT sum(n) FROM h) - 1 / 24.0)) AS tv, max(n) / nullif(min(n), 0) AS peak_trough FROM h""")
def _(spark, d):
    return series.hour_profile(c.posts(spark, d))


@query("w4_sortedness", "ok:b t_min:i t_max:i", "posts", GAPS + " SELECT (SELECT min(dt) >= 0 FROM gp) AS ok, min(ts_ms) AS t_min, max(ts_ms) AS t_max FROM posts")
def _(spark, d):
    p = c.posts(spark, d)
    return series.gaps(p).agg((F.min("dt") >= 0).alias("ok")).join(p.agg(F.min("ts_ms").alias("t_min"), F.max("ts_ms").alias("t_max")), how="cross")


@query("a13_propagation", "item_id:i log_n:f root_share:f mean_degree:f depth:i edge_share:f user_share:f", "cascade_nodes cascade_edges", """e AS (SELECT item_id, count(*) AS e, count(*) FILTER (WHERE parent = 0) AS r FROM cascade_edges GROUP BY 1),
n AS (SELECT item_id, count(*) AS n, count(DISTINCT uid) AS u FROM cascade_nodes GROUP BY 1),
d AS (WITH RECURSIVE t(item_id, node, depth) AS (SELECT DISTINCT item_id, 0, 0 FROM cascade_edges UNION ALL SELECT c.item_id, c.child, t.depth + 1 FROM t JOIN cascade_edges c ON c.item_id = t.item_id AND c.parent = t.node) SELECT item_id, max(depth) AS depth FROM t GROUP BY 1)
SELECT item_id, ln(1 + n) AS log_n, coalesce(r, 0) / n AS root_share, 2 * coalesce(e, 0) / n AS mean_degree, coalesce(depth, 0) AS depth, coalesce(e, 0) / n AS edge_share, u / n AS user_share FROM n LEFT JOIN e USING (item_id) LEFT JOIN d USING (item_id)""")
def _(spark, d):
    e = c.cascade_edges(spark, d)
    n = c.cascade_nodes(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u"))
    k = e.groupBy("item_id").agg(F.count("*").alias("e"), F.count_if(F.col("parent") == 0).alias("r"))
    deep = graph.cascade_depths(e).groupBy("item_id").agg(F.max("depth").alias("depth"))
    x = n.join(k, "item_id", "left").join(deep, "item_id", "left").na.fill(0)
    return x.select("item_id", F.log1p("n").alias("log_n"), ratio(F.col("r"), F.col("n")).alias("root_share"), ratio(2 * F.col("e"), F.col("n")).alias("mean_degree"), "depth", ratio(F.col("e"), F.col("n")).alias("edge_share"), ratio(F.col("u"), F.col("n")).alias("user_share"))


TIMES = {"log_span": "ln(1 + max(delay_min) - min(delay_min))", "log_median": "ln(1 + greatest(quantile_cont(delay_min, 0.5), 0))", "rate": "n / ((max(delay_min) - min(delay_min)) / 60 + 1)",
         "log_p90": "ln(1 + greatest(quantile_cont(delay_min, 0.9), 0))", "first_hour": "avg(CASE WHEN delay_min <= 60 THEN 1 WHEN delay_min IS NOT NULL THEN 0 END)"}


@query("a14_cascade_times", "item_id:i log_span:f log_median:f rate:f log_p90:f first_hour:f", "cascade_nodes", """k AS (SELECT *, CASE WHEN node % 7 <> 5 AND item_id % 10 <> 3 OR node = 0 THEN delay_raw END AS delay_min, count(*) OVER (PARTITION BY item_id) AS n
FROM (SELECT item_id, node, delay_min AS delay_raw FROM cascade_nodes)) SELECT item_id, """ + ", ".join(f"CASE WHEN count(delay_min) < 2 THEN 0 ELSE {v.replace('n / ', 'any_value(n) / ')} END AS {k}" for k, v in TIMES.items()) + " FROM k GROUP BY 1")
def _(spark, d):
    """Some delays are left unknown, in every tenth item all but the source's."""
    known = (F.col("node") % 7 != 5) & (F.col("item_id") % 10 != 3) | (F.col("node") == 0)
    return series.cascade_times(c.cascade_nodes(spark, d).withColumn("delay_min", F.when(known, F.col("delay_min"))))


@query("w6_best_row", "account_id:i post_id:i value:f", "posts", "SELECT account_id, post_id, value FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY value DESC, post_id) AS r FROM posts) WHERE r = 1")
def _(spark, d):
    w = Window.partitionBy("account_id").orderBy(F.desc("value"), "post_id")
    return c.posts(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1")
