"""Queries on summaries, histograms, label and profile features."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.scalars import days_since, parsed_time
from weftline.operators import graph, series, summaries, temporal
from weftline.plans.base import query
from weftline.plans.series_queries import BURST, GAPS
from weftline.sources import canonical as c


@query("a12_label_counts", "lang:s place:i n:i", "", "SELECT l.lang, place, count(doc_id) AS n FROM (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3), ('it', 4)) l(lang, place) LEFT JOIN documents d ON d.lang = l.lang GROUP BY 1, 2")
def _(spark, d):
    return summaries.label_counts(c.table(spark, d, "documents"), "lang", ["de", "en", "es", "fr", "it"])


@query("a12_cascade_summary", "median_nodes:f max_nodes:i mean_depth:f", "cascade_nodes cascade_edges", """d AS (WITH RECURSIVE t(item_id, node, depth) AS (SELECT DISTINCT item_id, 0, 0 FROM cascade_edges UNION ALL SELECT c.item_id, c.child, t.depth + 1 FROM t JOIN cascade_edges c ON c.item_id = t.item_id AND c.parent = t.node)
SELECT item_id, max(depth) AS depth FROM t GROUP BY 1), n AS (SELECT item_id, count(*) AS n FROM cascade_nodes GROUP BY 1) SELECT median(n) AS median_nodes, max(n) AS max_nodes, avg(coalesce(depth, 0)) AS mean_depth FROM n LEFT JOIN d USING (item_id)""")
def _(spark, d):
    return summaries.cascade_summary(c.cascade_nodes(spark, d), graph.cascade_depths(c.cascade_edges(spark, d)))


PER = "pa AS (SELECT account_id, any_value(label) AS label, count(*)::DOUBLE AS n, avg(value) AS m, max(value) AS x FROM posts JOIN accounts USING (account_id) GROUP BY 1)"


def per_account(spark, d):
    p = c.posts(spark, d).groupBy("account_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.max("value").alias("x"))
    return p.join(c.accounts(spark, d).select("account_id", "label"), "account_id")


@query("a15_by_class", "label:i feature:s n:i mean:f median:f sd:f lo:f hi:f", "posts accounts", PER + """, u AS (SELECT label, unnest(['n', 'm', 'x']) AS feature, unnest([n, m, x]) AS v FROM pa)
SELECT label, feature, count(v) AS n, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1, 2""")
def _(spark, d):
    return summaries.by_class(per_account(spark, d), "label", ["n", "m", "x"])


@query("a22_count_correlation", "feature:s r:f", "posts accounts", PER + ", u AS (SELECT ln(1 + n) AS y, unnest(['m', 'x', 'label']) AS feature, unnest([m, x, label]) AS v FROM pa) SELECT feature, CASE WHEN stddev_pop(v) > 0 AND stddev_pop(y) > 0 THEN corr(v, y) END AS r FROM u GROUP BY 1")
def _(spark, d):
    return summaries.correlations(per_account(spark, d), ["m", "x", "label"], F.log1p("n"))


@query("a2_count_summary", "accounts:i median_n:f max_n:i", "posts accounts", "n AS (SELECT account_id, count(post_id) AS n FROM accounts LEFT JOIN posts USING (account_id) GROUP BY 1) SELECT count(*) AS accounts, median(n) AS median_n, max(n) AS max_n FROM n")
def _(spark, d):
    n = c.posts(spark, d).groupBy("account_id").agg(F.count("*").alias("n"))
    x = c.accounts(spark, d).join(n, "account_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return x.agg(F.count("*").alias("accounts"), F.median("n").alias("median_n"), F.max("n").alias("max_n"))


def width_sql(value: str, lo: str, hi: str, bins: int, source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""b AS (SELECT {keys}least(floor(({value} - {lo}) * {bins} / ({hi} - {lo})), {bins - 1})::INTEGER AS bin, ({hi} - {lo}) / {bins} AS width FROM {source} WHERE {value} BETWEEN {lo} AND {hi}),
k AS (SELECT {keys}bin, width, count(*) AS n FROM b GROUP BY ALL) SELECT {keys}bin, n, n / (sum(n) OVER ({f'PARTITION BY {by}' if by else ''}) * width) AS density FROM k"""


@query("e16_timeline", "bin:i n:i density:f", "posts", "tl AS (SELECT ts_ms::DOUBLE AS t, (SELECT min(ts_ms)::DOUBLE FROM posts) AS lo, (SELECT max(ts_ms)::DOUBLE FROM posts) AS hi FROM posts), " + width_sql("t", "lo", "hi", 400, "tl"))
def _(spark, d):
    return summaries.histogram(c.posts(spark, d), "ts_ms", 400)


@query("e16_hours", "label:i bin:i n:i density:f", "posts accounts", "hr AS (SELECT label, (ts_ms % 86400000) / 3600000.0 AS h FROM posts JOIN accounts USING (account_id)), " + width_sql("h", "0.0", "24.0", 48, "hr", "label"))
def _(spark, d):
    p = c.posts(spark, d).join(c.accounts(spark, d).select("account_id", "label"), "account_id")
    return summaries.histogram(p.withColumn("h", (F.col("ts_ms") % 86_400_000) / 3_600_000.0), "h", 48, 0.0, 24.0, ["label"])


YEAR = 365 * 86_400_000.0
EDGES = "[" + ", ".join(repr(YEAR ** (i / 79)) for i in range(79)) + "]"


@query("e16_gap_bins", "label:i bin:i n:i", "posts accounts", GAPS + f", k AS (SELECT label, dt FROM gp JOIN accounts USING (account_id)) SELECT label, CASE WHEN dt <= 0 THEN 0 ELSE len(list_filter({EDGES}, lambda e: e <= dt)) END AS bin, count(*) AS n FROM k WHERE dt <= 0 OR dt BETWEEN 1 AND {YEAR} GROUP BY 1, 2")
def _(spark, d):
    g = series.gaps(c.posts(spark, d)).join(c.accounts(spark, d).select("account_id", "label"), "account_id")
    return series.log_bins(g, "label", 79, 1.0, YEAR)


@query("e5_own_range", "account_id:i bin:i n:i", "posts", GAPS + """, m AS (SELECT account_id, greatest(max(dt), 10)::DOUBLE AS hi FROM gp GROUP BY 1), k AS (SELECT gp.account_id, dt, hi FROM gp JOIN m USING (account_id))
SELECT account_id, CASE WHEN dt <= 0 THEN 0 ELSE len(list_filter(range(24), lambda i: pow(hi, i / 24) <= dt)) END AS bin, count(*) AS n FROM k GROUP BY 1, 2""")
def _(spark, d):
    return series.log_bins_own(series.gaps(c.posts(spark, d)), "account_id")


@query("e4_probabilities", "account_id:i bin:i p:f", "posts", "h AS (SELECT account_id, (ts_ms % 86400000) // 3600000 AS bin, count(*) AS n FROM posts GROUP BY 1, 2) SELECT account_id, bin, n / sum(n) OVER (PARTITION BY account_id) AS p FROM h")
def _(spark, d):
    return series.probabilities(series.hours(c.posts(spark, d)), "account_id")


@query("f1_reindexed", "src:i dst:i ts:i post_id:i", "posts", """e AS (SELECT src, dst, ts, post_id, row_number() OVER (ORDER BY ts, post_id) - 1 AS pos FROM (
SELECT account_id AS src, lag(account_id) OVER (PARTITION BY item_id ORDER BY ts_ms, post_id) AS dst, ts_ms // 1000 AS ts, post_id FROM posts) WHERE dst IS NOT NULL),
s AS (SELECT label, min(spot) AS f FROM (SELECT src AS label, pos * 2 AS spot FROM e UNION ALL SELECT dst, pos * 2 + 1 FROM e) GROUP BY 1), i AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS idx FROM s)
SELECT a.idx AS src, b.idx AS dst, ts, post_id FROM e JOIN i a ON a.label = src JOIN i b ON b.label = dst""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("item_id").orderBy("ts_ms", "post_id")
    e = c.posts(spark, d).withColumn("dst", F.lag("account_id").over(w)).filter("dst IS NOT NULL").select(F.col("account_id").alias("src"), "dst", F.floor(F.col("ts_ms") / 1000).alias("ts"), "post_id")
    return summaries.reindexed(e, ["ts", "post_id"])[0]


@query("f5_account_age", "account_id:i days:i", "posts accounts", "SELECT account_id, greatest(floor((epoch_ms(TIMESTAMP '2024-01-20') - created_ms) / 86400000.0), 0) AS days FROM accounts")
def _(spark, d):
    a = c.accounts(spark, d)
    return a.select("account_id", days_since(F.timestamp_millis("created_ms"), "2024-01-20").alias("days"))


STAMP = """st AS (SELECT post_id, ts_ms // 1000 AS s, CASE post_id % 4 WHEN 0 THEN strftime(make_timestamp(ts_ms // 1000 * 1000000), '%a %b %d %H:%M:%S +0000 %Y') WHEN 1 THEN strftime(make_timestamp(ts_ms // 1000 * 1000000), '%a %b %d %H:%M:%S %Y')
WHEN 2 THEN strftime(make_timestamp(ts_ms // 1000 * 1000000), '%Y-%m-%d %H:%M:%S') ELSE 'no date ' || post_id END AS stamp FROM posts)"""


@query("f6_parsed_dates", "post_id:i s:i", "posts", STAMP + " SELECT post_id, CASE WHEN post_id % 4 <> 3 THEN s END AS s FROM st")
def _(spark, d):
    p = c.posts(spark, d).withColumn("t", F.timestamp_seconds(F.floor(F.col("ts_ms") / 1000)))
    day = F.element_at(F.array(*[F.lit(x) for x in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")]), F.dayofweek("t"))
    k = F.col("post_id") % 4
    long = F.concat(day, F.lit(" "), F.date_format("t", "MMM dd HH:mm:ss"))
    stamp = F.when(k == 0, F.concat(long, F.lit(" +0000 "), F.date_format("t", "yyyy"))).when(k == 1, F.concat(long, F.lit(" "), F.date_format("t", "yyyy"))).when(k == 2, F.date_format("t", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("no date "), F.col("post_id")))
    return p.select("post_id", F.unix_seconds(parsed_time(stamp)).alias("s"))


PROFILE = "[ln(1 + greatest(c_acctbal, 0)), ln(1 + c_custkey % 90), greatest(c_acctbal, 0) / (c_custkey % 90 + 1), ln(1 + c_nationkey), ln(1 + CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 ELSE 0 END), (c_custkey % 5 = 0)::INTEGER, (c_custkey % 4 > 0)::INTEGER]"


@query("f11_profile_block", "c_custkey:i pos:i v:f", "", f"SELECT c_custkey, unnest({PROFILE}) AS v, unnest(range(7)) AS pos FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    block = summaries.profile_block(F.greatest("c_acctbal", F.lit(0)), k % 90, F.col("c_nationkey"), F.when(k % 3 > 0, k % 3), F.when(k % 7 < 6, k % 5 == 0).otherwise(k % 5 == 0), F.when(k % 4 > 0, "text").otherwise(""))
    return c.table(spark, d, "customer").select("c_custkey", F.posexplode(block).alias("pos", "v"))


@query("f12_one_hot", "c_custkey:i hot:s", "", """p AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'none' ELSE c_mktsegment END AS v FROM customer), k AS (SELECT list(DISTINCT v) AS cats FROM p)
SELECT c_custkey, array_to_string(list_transform(list_sort(cats), lambda x: CASE WHEN x = v THEN '1' ELSE '0' END), '') AS hot FROM p, k""")
def _(spark, d):
    k = F.col("c_custkey") % 22
    rows = c.table(spark, d, "customer").select("c_custkey", F.when(k == 0, " ").when(k == 11, None).otherwise(F.col("c_mktsegment")).alias("party"))
    return summaries.one_hot(rows, "party").select("c_custkey", F.array_join(F.transform("hot", lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query("f13_source_profiles", "item_id:i v:f", "cascade_nodes", "i AS (SELECT DISTINCT item_id FROM cascade_nodes) SELECT i.item_id, coalesce(value, 0) AS v FROM i LEFT JOIN cascade_nodes n ON n.item_id = i.item_id AND node = 0 AND i.item_id % 10 <> 3")
def _(spark, d):
    n = c.cascade_nodes(spark, d)
    return summaries.source_profiles(n.select("item_id").distinct(), n.filter("item_id % 10 <> 3").select("item_id", "node", F.array("value").alias("profile")), 1).select("item_id", F.element_at("x", 1).alias("v"))


@query("f14_veracity", "post_id:i veracity:s", "posts", """a AS (SELECT post_id, CASE WHEN post_id % 3 < 2 THEN post_id % 3 END AS m, CASE WHEN post_id // 3 % 3 < 2 THEN post_id // 3 % 3 END AS t FROM posts)
SELECT post_id, CASE WHEN m IS NULL THEN NULL WHEN t IS NULL THEN CASE m WHEN 0 THEN 'unverified' ELSE 'false' END WHEN m = 0 AND t = 0 THEN 'unverified' WHEN m = 0 THEN 'true' WHEN t = 0 THEN 'false' END AS veracity FROM a""")
def _(spark, d):
    m, t = F.col("post_id") % 3, F.floor(F.col("post_id") / 3) % 3
    return c.posts(spark, d).select("post_id", summaries.veracity(F.when(m < 2, m), F.when(t < 2, t)).alias("veracity"))


@query("f15_binarised", "post_id:i fake:i", "posts", "SELECT post_id, (event_type IN (SELECT DISTINCT event_type FROM posts ORDER BY 1 LIMIT 2))::INTEGER AS fake FROM posts")
def _(spark, d):
    p = c.posts(spark, d)
    first = [r[0] for r in p.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return p.select("post_id", summaries.binarised(F.col("event_type"), first).alias("fake"))


@query("f16_time_weight", "delta:i weight:f memory:i", "", "SELECT delta, exp(-1.2 * delta) AS weight, 3 AS memory FROM (SELECT DISTINCT l_linenumber - 1 AS delta FROM lineitem)")
def _(spark, d):
    x = c.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("delta")).distinct()
    return x.select("delta", F.exp(-1.2 * F.col("delta")).alias("weight"), F.lit(temporal.memory_length(1.2)).alias("memory"))


@query("f18_credit_block", "c_custkey:i pos:i v:f", "", "SELECT c_custkey, unnest([ln(1 + c_custkey % 7), ln(1 + c_nationkey), 0]) AS v, unnest(range(3)) AS pos FROM customer")
def _(spark, d):
    block = summaries.credit_block(F.array(F.col("c_custkey") % 7, F.col("c_nationkey"), F.lit(0)))
    return c.table(spark, d, "customer").select("c_custkey", F.posexplode(block).alias("pos", "v"))


@query("f19_exploded_values", "item_id:i value:s", "items", """SELECT item_id, lang AS value FROM items UNION ALL SELECT item_id, "group" FROM items""")
def _(spark, d):
    return summaries.exploded_values(c.items(spark, d).withColumn("meta", F.concat("lang", F.lit(" , ,"), "group")), "meta").select("item_id", "value")


@query("f21_expanded", "item_id:i pos:i v:f", "", "SELECT d.doc_id AS item_id, r.pos, coalesce(v, 0) AS v FROM documents d CROSS JOIN range(3) r(pos) LEFT JOIN (SELECT doc_id, unnest(range(3)) AS pos, unnest([quality, toxic, 1]) AS v FROM labels) l ON l.doc_id = d.doc_id AND l.pos = r.pos")
def _(spark, d):
    v = c.table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.lit(1.0)).alias("vec"))
    return summaries.expanded(c.table(spark, d, "documents").select("doc_id"), v, "doc_id", "vec", 3).select(F.col("doc_id").alias("item_id"), F.posexplode("vec").alias("pos", "v"))


@query("a5_memory", "account_id:i memory:f", "posts", BURST + " SELECT account_id, memory FROM bursts")
def _(spark, d):
    return series.bursts(series.gaps(c.posts(spark, d)))


@query("w2_gap_pairs", "post_id:i a:i b:i", "posts", GAPS + " SELECT post_id, dt AS a, lead(dt) OVER (PARTITION BY account_id ORDER BY ts_ms, post_id) AS b FROM gp QUALIFY b IS NOT NULL")
def _(spark, d):
    return series.gap_pairs(series.gaps(c.posts(spark, d)))


@query("m23_gate", "range_ok:b order_ok:b ages_ok:b retention_ok:b passes:b", "posts accounts", GAPS + """, r AS (SELECT min(ts_ms) >= 0 AND max(ts_ms) <= 4102444800000 AS range_ok FROM posts), o AS (SELECT min(dt) >= 0 AS order_ok FROM gp),
a AS (SELECT avg((ts_ms < created_ms)::INTEGER) < 0.001 AS ages_ok FROM posts JOIN accounts USING (account_id)), k AS (SELECT min(share) >= 0.8 AS retention_ok FROM (SELECT label, avg((n >= 32)::INTEGER) AS share FROM accounts LEFT JOIN (SELECT account_id, count(*) AS n FROM posts GROUP BY 1) USING (account_id) GROUP BY label))
SELECT *, range_ok AND order_ok AND ages_ok AND retention_ok AS passes FROM r, o, a, k""")
def _(spark, d):
    return series.gate(c.posts(spark, d), c.accounts(spark, d))
