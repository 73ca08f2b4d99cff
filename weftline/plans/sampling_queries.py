"""Queries on splits, samples, walks and perturbed snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.scalars import ROUNDS, draw
from weftline.operators import graph, passing, protocols, sampling, summaries, temporal
from weftline.plans.base import query
from weftline.plans.graph_queries import INTER, PAIRS, SIMPLE, daily, inter, sym
from weftline.sources import canonical as c

DRAW = "('0x' || substr(md5({0} || '|{1}'), 1, 8))::UBIGINT / 4294967296.0"


@query("t2_count_split", "split:s n:i t0:i t1:i", "interactions", """o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM interactions),
k AS (SELECT max(ts) FILTER (WHERE i = floor(0.8 * n)) AS c1, max(ts) FILTER (WHERE i = floor(0.9 * n)) AS c2 FROM o)
SELECT CASE WHEN ts <= c1 THEN 'train' WHEN ts <= c2 THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM interactions, k GROUP BY 1""")
def _(spark, d):
    s = temporal.chronological_split(c.interactions(spark, d), 0.8, 0.1, "count")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))


def _negatives(name: str, split: str, seed: int) -> str:
    a, b = (f"floor({DRAW.format(f'i || ' + chr(39) + f'|{x}' + chr(39), seed)} * size)::BIGINT" for x in "ab")
    return f"""n{name} AS (SELECT count(*) AS k, (SELECT count(*) FROM nodes) AS size FROM pos WHERE split = '{split}'),
d{name} AS (SELECT i, {a} AS a, {b} AS b FROM n{name}, range(200 * (SELECT k FROM n{name})) r(i)),
g{name} AS (SELECT '{split}' AS split, u, v, row_number() OVER (ORDER BY i) - 1 AS place, (SELECT k FROM n{name}) AS k FROM (SELECT i, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v FROM d{name} JOIN nodes x ON a = x.idx JOIN nodes y ON b = y.idx WHERE a <> b) p
WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.u = p.u AND ap.v = p.v) ORDER BY i LIMIT (SELECT k FROM n{name}))"""


def _samples(edges: str, new_only: bool, seed: int) -> str:
    """CTEs of the positive pairs `pos` and of each split's negatives."""
    fresh = "SELECT * FROM ps WHERE split = 'train' AND (u, v) NOT IN (SELECT (u, v) FROM ps WHERE split = 'messages') UNION ALL SELECT * FROM ps WHERE split IN ('val', 'test') AND (u, v) NOT IN (SELECT (u, v) FROM ps WHERE split IN ('messages', 'train'))"
    return f"""e AS (SELECT src, dst, ts FROM {edges} WHERE src <> dst), m AS (SELECT min(ts) AS a, max(ts) AS b FROM {edges}),
s AS (SELECT src, dst, ts, CASE WHEN ts <= a + 0.8 * (b - a) THEN 'train' WHEN ts <= a + 0.9 * (b - a) THEN 'val' ELSE 'test' END AS split FROM e, m),
t AS (SELECT a, a + 0.8 * (b - a) AS b FROM m),
ps AS (SELECT DISTINCT CASE WHEN split = 'train' AND ts <= a + 0.8 * (b - a) THEN 'messages' ELSE split END AS split, least(src, dst) AS u, greatest(src, dst) AS v FROM s, t),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})),
ap AS (SELECT DISTINCT u, v FROM ps),
pos AS ({fresh if new_only else "SELECT * FROM ps WHERE split <> 'messages'"}),
""" + ", ".join(_negatives(x, x, seed + i) for i, x in enumerate(("train", "val", "test")))


RATIO_SQL = _samples("interactions", False, 21) + """, gs AS (SELECT * FROM gtrain UNION ALL SELECT * FROM gval UNION ALL SELECT * FROM gtest)
SELECT ratio, split, u, v, 1 AS label FROM pos, (SELECT unnest([0.25, 1.0]::DOUBLE[]) AS ratio) UNION ALL SELECT ratio, split, u, v, 0 FROM gs, (SELECT unnest([0.25, 1.0]::DOUBLE[]) AS ratio) WHERE place < round_even(ratio * k, 0)"""


@query("t3_link_samples", "split:s u:i v:i label:i", "reply_edges", _samples("reply_edges", True, 21) + " SELECT split, u, v, 1 AS label FROM pos UNION ALL SELECT split, u, v, 0 FROM gtrain UNION ALL SELECT split, u, v, 0 FROM gval UNION ALL SELECT split, u, v, 0 FROM gtest")
def _(spark, d):
    return temporal.link_samples(c.reply_edges(spark, d), seed=21)


SPLIT = f"CASE WHEN {DRAW.format('doc_id', 17)} < 0.7 THEN 'train' WHEN {DRAW.format('doc_id', 17)} < 0.85 THEN 'val' ELSE 'test' END"


def official(spark, d):
    r = draw("doc_id", seed=17)
    return c.table(spark, d, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines"), F.when(r < 0.7, "train").when(r < 0.85, "val").otherwise("test").alias("split"))


@query("t7_official_split", "doc_id:i split:s quality:i", "", f"SELECT doc_id, {SPLIT} AS split, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    return sampling.labelled_split(official(spark, d), c.table(spark, d, "labels"), "doc_id")


@query("t7_empty_part", "doc_id:i split:s quality:i", "", f"SELECT doc_id, {SPLIT} AS split, quality FROM documents JOIN labels USING (doc_id) WHERE false")
def _(spark, d):
    return sampling.labelled_split(official(spark, d).filter("split <> 'val'"), c.table(spark, d, "labels"), "doc_id")


@query("t8_split_drift", "feature:s auc:f train_median:f test_median:f", "", f"""f AS (SELECT {SPLIT} AS split, unnest(['chars', 'lines']) AS feature, unnest([ln(1 + n_chars), ln(1 + len(string_split(text, chr(10))))]) AS score FROM documents),
k AS (SELECT feature, score, count(*) FILTER (WHERE split = 'test') AS p, count(*) FILTER (WHERE split = 'train') AS n FROM f WHERE split <> 'val' GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
m AS (SELECT feature, median(score) FILTER (WHERE split = 'train') AS train_median, median(score) FILTER (WHERE split = 'test') AS test_median FROM f GROUP BY 1)
SELECT feature, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc, any_value(train_median) AS train_median, any_value(test_median) AS test_median FROM b JOIN m USING (feature) GROUP BY 1""")
def _(spark, d):
    x = official(spark, d).select("split", F.log1p("n_chars").alias("chars"), F.log1p("lines").alias("lines"))
    return sampling.split_drift(x, ["chars", "lines"])


KEY = f"floor({DRAW.format("w || '|' || r || '|k'", 7)} * n)::BIGINT"


@query("r2_augmented", "w:i u:i v:i", "interactions", INTER + f""", nd AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT u AS node FROM snaps UNION SELECT v FROM snaps)),
sz AS (SELECT count(*) AS n, max(node) AS top, round_even(count(*) * 0.02, 0) AS dn, round_even(count(*) * 0.05, 0) AS an FROM nd),
er AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY {DRAW.format("w || '|' || u || '|' || v", 6)}, u, v) AS r, count(*) OVER (PARTITION BY w) AS m FROM snaps),
ws AS (SELECT w, count(*) AS m FROM snaps GROUP BY w),
pv AS (SELECT w, n, list_reduce(range(1, {ROUNDS + 1}), lambda x, r: CASE WHEN {DRAW.format("w || '|' || r || '|' || greatest(x, ((" + KEY + " - x) % n + n) % n) || '|s'", 7)} < 0.5 THEN (({KEY} - x) % n + n) % n ELSE x END, i) AS idx FROM ws, sz, range((SELECT dn FROM sz)::BIGINT) z(i)),
vc AS (SELECT w, node, idx FROM pv JOIN nd USING (idx)),
lf AS (SELECT w, u, v FROM er WHERE r > round_even(m * 0.02, 0) AND (w, u) NOT IN (SELECT (w, node) FROM vc) AND (w, v) NOT IN (SELECT (w, node) FROM vc)),
tr AS (SELECT w, round_even(m * 0.05, 0) AS k, unnest(range((2 * round_even(m * 0.05, 0))::BIGINT)) AS i FROM ws),
dr AS (SELECT w, k, i, floor({DRAW.format("w || '|' || i || '|a'", 8)} * (n + an))::BIGINT AS a, floor({DRAW.format("w || '|' || i || '|b'", 8)} * (n + an))::BIGINT AS b FROM tr, sz),
ok AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY i) AS r FROM dr WHERE (w, a) NOT IN (SELECT (w, idx) FROM vc) AND (w, b) NOT IN (SELECT (w, idx) FROM vc)),
ad AS (SELECT w, coalesce(x.node, a - n + top + 1) AS p, coalesce(y.node, b - n + top + 1) AS q FROM ok CROSS JOIN sz LEFT JOIN nd x ON x.idx = a LEFT JOIN nd y ON y.idx = b WHERE r <= k AND a <> b)
SELECT * FROM lf UNION SELECT w, least(p, q), greatest(p, q) FROM ad""")
def _(spark, d):
    return sampling.augment(inter(spark, d), seed=6)


@query("r5_rings", "src:i dst:i", "items", """r AS (SELECT 'lang' AS attr, lang AS value, item_id, round FROM items, range(3) z(round)),
h AS (SELECT *, substr(md5(attr || '|' || value || '|' || round || '|' || item_id || '|0'), 1, 16) AS h FROM r)
SELECT item_id AS src, coalesce(lead(item_id) OVER w, first(item_id) OVER w) AS dst FROM h WINDOW w AS (PARTITION BY attr, value, round ORDER BY h, item_id)""")
def _(spark, d):
    return graph.random_rings(c.items(spark, d).select(F.lit("lang").alias("attr"), F.col("lang").alias("value"), "item_id"), 3)


@query("r6_capped_pairs", "post_id:i item_id:i", "posts", f"SELECT post_id, item_id FROM (SELECT post_id, item_id, row_number() OVER (ORDER BY {DRAW.format('post_id', 31)}, post_id) AS r FROM posts) WHERE r <= 500")
def _(spark, d):
    return sampling.lowest_draws(c.posts(spark, d).select("post_id", "item_id"), "post_id", 500, seed=31)


@query("r7_sampled_accounts", "label:i account_id:i n:i", "posts accounts", f"""k AS (SELECT account_id, any_value(label) AS label, count(*) AS n FROM posts JOIN accounts USING (account_id) GROUP BY 1 HAVING count(*) > 50)
SELECT label, account_id, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {DRAW.format('account_id', 12)}, account_id) AS r FROM k) WHERE r <= 30""")
def _(spark, d):
    n = c.posts(spark, d).groupBy("account_id").agg(F.count("*").alias("n")).filter("n > 50").join(c.accounts(spark, d).select("account_id", "label"), "account_id")
    return passing.ranked_by_hash(n, ["label"], "account_id", 30, seed=12)


NEAR = SIMPLE + ", lk AS (SELECT src AS node, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS deg FROM sym), w0 AS (SELECT walk, node AS start, NULL::BIGINT AS last, node FROM (SELECT DISTINCT node FROM lk), range(2) r(walk))"
WALK = "start || '|' || walk || '|{i}"
#: Draws a step that the SQL tries; the least weight over the largest is 1/8, so all of them are rejected once in 10^14.
TRIES = sampling.MOST_TRIES


def _walks_sql(steps: int, p: float, q: float) -> str:
    sql, top = NEAR, max(1 / p, 1.0, 1 / q)
    for i in range(1, steps):
        if i == 1 or p == q == 1:
            r = DRAW.format(WALK.replace("{i}", str(i)) + "'", 14)
            sql += f", w{i} AS (SELECT walk, start, w.node AS last, dst AS node FROM w{i - 1} w JOIN lk ON lk.node = w.node WHERE k = floor({r} * deg))"
        else:
            r, taken = (DRAW.format(WALK.replace("{i}", str(i)) + f"|' || t{rest}", 14) for rest in ("", " || '|w'"))
            sql += f""", d{i} AS (SELECT DISTINCT node, deg FROM lk), x{i} AS (SELECT walk, start, w.last, w.node, t, floor({r} * deg)::BIGINT AS k, {taken} AS u FROM w{i - 1} w JOIN d{i} USING (node), range({TRIES}) z(t)),
y{i} AS (SELECT x.*, lk.dst AS next, CASE WHEN lk.dst = x.last THEN {1 / p} WHEN s.src IS NOT NULL THEN 1.0 ELSE {1 / q} END AS weight FROM x{i} x JOIN lk ON lk.node = x.node AND lk.k = x.k LEFT JOIN sym s ON s.src = x.last AND s.dst = lk.dst),
w{i} AS (SELECT walk, start, arg_min(node, t) AS last, arg_min(next, t) AS node FROM y{i} WHERE u < weight / {top} GROUP BY walk, start)"""
    return sql + " " + " UNION ALL ".join(f"SELECT walk, start, {i} AS step, node FROM w{i}" for i in range(steps))


@query("r8_random_walks", "walk:i start:i step:i node:i", "reply_edges", _walks_sql(6, 1, 1))
def _(spark, d):
    return sampling.random_walks(sym(spark, d), 2, 6, seed=14)


@query("r8_biased_walks", "walk:i start:i step:i node:i", "reply_edges", _walks_sql(4, 4.0, 0.5))
def _(spark, d):
    return sampling.random_walks(sym(spark, d), 2, 4, p=4.0, q=0.5, seed=14)


@query("e14_spectrum_by_size", "n:i accounts:i mean_H_1:f sd_H_1:f mean_H_0:f sd_H_0:f", "posts", f"""p AS (SELECT account_id, post_id, (ts_ms % 86400000) // 3600000 AS bin, count(*) OVER (PARTITION BY account_id) AS al FROM posts),
g AS (SELECT *, row_number() OVER (PARTITION BY account_id, rep ORDER BY {DRAW.format("post_id || '|' || rep", 19)}, post_id) AS r FROM p, range(3) z(rep)),
s AS (SELECT account_id, rep, n, bin, count(*) AS k FROM g, (SELECT unnest([16, 32]) AS n) WHERE r <= n AND al >= n GROUP BY 1, 2, 3, 4),
h AS (SELECT account_id, rep, n, ln(count(*)) / ln(2) AS h0, (ln(sum(k)) - sum(k * ln(k)) / sum(k)) / ln(2) AS h1 FROM s GROUP BY 1, 2, 3)
SELECT n, count(DISTINCT account_id) AS accounts, avg(h1) AS mean_H_1, stddev_pop(h1) AS sd_H_1, avg(h0) AS mean_H_0, stddev_pop(h0) AS sd_H_0 FROM h GROUP BY n""")
def _(spark, d):
    from weftline.functions.scalars import hour_of_day
    from weftline.operators.series import entropy_bits

    p = c.posts(spark, d).select("account_id", "post_id", hour_of_day(F.col("ts_ms")).alias("bin"))
    counts = sampling.subsampled(p, "account_id", "post_id", [16, 32], 3, seed=19).groupBy("account_id", "rep", "n", "bin").agg(F.count("*").alias("k"))
    h = counts.groupBy("account_id", "rep", "n").agg(entropy_bits(0.0, F.col("k")).alias("h0"), entropy_bits(1.0, F.col("k")).alias("h1"))
    return h.groupBy("n").agg(F.countDistinct("account_id").alias("accounts"), F.avg("h1").alias("mean_H_1"), F.stddev_pop("h1").alias("sd_H_1"), F.avg("h0").alias("mean_H_0"), F.stddev_pop("h0").alias("sd_H_0"))


# ---- sets and order
@query("u1_pairs", "u:i v:i", "reply_edges", PAIRS + " SELECT u, v FROM pairs")
def _(spark, d):
    return temporal.undirected_pairs(c.reply_edges(spark, d))


@query("u3_union", "u:i v:i", "reply_edges interactions", "SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM reply_edges WHERE src <> dst UNION SELECT least(src, dst), greatest(src, dst) FROM interactions WHERE src <> dst")
def _(spark, d):
    return temporal.undirected_pairs(c.reply_edges(spark, d)).union(temporal.undirected_pairs(c.interactions(spark, d))).distinct()


@query("u5_concatenated", "source:s account_id:i n:i", "posts", "SELECT 'All posts' AS source, account_id, count(*) AS n FROM posts GROUP BY 2 UNION ALL SELECT 'odd', account_id, count(*) FROM posts WHERE post_id % 2 = 1 GROUP BY 2")
def _(spark, d):
    p = c.posts(spark, d)
    n = lambda x: x.groupBy("account_id").agg(F.count("*").alias("n"))
    return summaries.concatenated([("all", n(p)), ("odd", n(p.filter("post_id % 2 = 1")))], {"all": "All posts"})


@query("u6_train_and_val", "doc_id:i", "", f"SELECT doc_id FROM documents WHERE {SPLIT} IN ('train', 'val')")
def _(spark, d):
    return official(spark, d).filter("split IN ('train', 'val')")


@query("u7_shared_names", "name:s", "", "SELECT lang AS name FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    x = c.table(spark, d, "documents")
    return x.filter("doc_id % 2 = 0").select(F.col("lang").alias("name")).intersect(x.filter("doc_id % 2 = 1").select("lang"))


TW = INTER + """, t AS (SELECT max(w) AS top FROM snaps),
fe AS (SELECT node, sum(CASE WHEN w = top THEN h ELSE 0 END) AS lne_last, sum(exp(-1.2 * (top - w)) * h) AS lne_tw FROM lne, t GROUP BY node), ky AS (SELECT node, lne_tw AS h FROM fe ORDER BY h DESC, node LIMIT 20)"""


@query("w5_key_nodes", "node:i h:f", "interactions", TW + " SELECT * FROM ky")
def _(spark, d):
    return summaries.key_nodes(temporal.entropy_features(inter(spark, d)), 20)


@query("w5_split_pairs", "u:i v:i score:f side:s place:i", "reply_edges", PAIRS + """, k AS (SELECT u, v, (u * 37 + v * 11) % 101 / 100.0 AS score FROM pairs)
SELECT u, v, score, CASE WHEN score >= 0.5 THEN 'linked' ELSE 'unlinked' END AS side, row_number() OVER (ORDER BY score DESC, u, v) - 1 AS place FROM k""")
def _(spark, d):
    p = temporal.undirected_pairs(c.reply_edges(spark, d)).withColumn("score", (F.col("u") * 37 + F.col("v") * 11) % 101 / 100)
    return protocols.split_predictions(p, 0.5)


@query("w9_hubs_and_keys", "node:i", "interactions", TW + ", dg AS (SELECT node, sum(deg) AS deg FROM (SELECT w, node, sum(CASE WHEN node = other THEN 2 ELSE 1 END) AS deg FROM nb GROUP BY 1, 2) GROUP BY 1 ORDER BY deg DESC, node LIMIT 15) SELECT node FROM dg UNION SELECT node FROM ky")
def _(spark, d):
    snaps = inter(spark, d)
    deg = temporal.degrees(snaps).groupBy("node").agg(F.sum("deg").alias("deg"))
    return summaries.hubs_and_keys(deg, summaries.key_nodes(temporal.entropy_features(snaps), 20), 15)


@query("w7_first_posts", "account_id:i post_id:i", "posts", "SELECT account_id, post_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY post_id) AS r FROM posts) WHERE r <= 15")
def _(spark, d):
    return summaries.first_posts(c.posts(spark, d), "account_id", ["post_id"], 15)


@query("w10_first_nodes", "item_id:i post_id:i uid:i", "cascade_nodes", "SELECT item_id, min_by(post_id, node) AS post_id, min_by(uid, node) AS uid FROM cascade_nodes GROUP BY 1")
def _(spark, d):
    return c.cascade_nodes(spark, d).groupBy("item_id").agg(F.min_by("post_id", "node").alias("post_id"), F.min_by("uid", "node").alias("uid"))


@query("w11_latest", "post_id:i ts_ms:i", "posts", "SELECT post_id, ts_ms FROM posts ORDER BY ts_ms DESC, post_id LIMIT 100")
def _(spark, d):
    return c.posts(spark, d).orderBy(F.desc("ts_ms"), "post_id").limit(100)


@query("w13_seed_spread", "method:s spread:f fold_sd:f", "posts", """r AS (SELECT event_type AS method, item_id % 5 AS seed, value FROM posts), b AS (SELECT method, seed, avg(value) AS m, stddev_samp(value) AS s FROM r GROUP BY 1, 2)
SELECT method, max(m) - min(m) AS spread, avg(s) AS fold_sd FROM b GROUP BY 1""")
def _(spark, d):
    return summaries.seed_spread(c.posts(spark, d).select(F.col("event_type").alias("method"), (F.col("item_id") % 5).alias("seed"), "value"))


@query("j9_against_published", "event_type:s obtained:f expected:f difference:f matches:b", "posts", """o AS (SELECT event_type, avg(value) AS obtained FROM posts WHERE event_type <> (SELECT min(event_type) FROM posts) GROUP BY 1), p AS (SELECT event_type, round(avg(value), 1) AS expected FROM posts GROUP BY 1)
SELECT event_type, obtained, expected, obtained - expected AS difference, coalesce(abs(obtained - expected) <= 0.02, false) AS matches FROM p LEFT JOIN o USING (event_type)""")
def _(spark, d):
    p = c.posts(spark, d).groupBy("event_type").agg(F.avg("value").alias("v"))
    least = p.agg(F.min("event_type").alias("_m"))
    ours = p.join(least, how="cross").filter("event_type <> _m").select("event_type", F.col("v").alias("obtained"))
    return summaries.against_published(ours, p.select("event_type", F.round("v", 1).alias("expected")), ["event_type"], 0.02)


@query("g3_receiver_degrees", "dst:i d:i", "reply_edges", SIMPLE + " SELECT dst, count(*) AS d FROM sym GROUP BY 1")
def _(spark, d):
    return sym(spark, d).groupBy("dst").agg(F.count("*").alias("d"))


@query("t1_daily_spine", "w:i n:i", "reply_edges", "b AS (SELECT (ts - (SELECT min(ts) FROM reply_edges)) // 86400 AS w, src, dst FROM reply_edges) SELECT s.w, count(DISTINCT (least(src, dst), greatest(src, dst))) FILTER (WHERE src IS NOT NULL) AS n FROM range((SELECT max(w) + 1 FROM b)) s(w) LEFT JOIN b ON b.w = s.w GROUP BY 1")
def _(spark, d):
    snaps = daily(spark, d)
    return temporal.window_spine(snaps).join(snaps.groupBy("w").agg(F.count("*").alias("n")), "w", "left").na.fill(0, ["n"])
