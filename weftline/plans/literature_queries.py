"""Queries of the meta-analysis, on method tables made from the given parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import literature
from weftline.plans.base import query
from weftline.sources import canonical as c

#: One method a part; its results are the part's line items.
SQL = """rs AS (SELECT l_partkey, [l_returnflag || l_linestatus, 'x' || l_linenumber][1 + (l_linenumber > 4)::INTEGER] AS dataset, CASE WHEN l_linenumber % 2 = 1 THEN 'ACC' ELSE 'F1' END AS metric, l_orderkey, l_linenumber, round(0.3 + l_tax * 5 + l_discount * 2, 3) AS value FROM lineitem),
me AS (SELECT p_partkey AS method_id, p_brand AS ref, 2019 + p_size % 4 AS year, list_distinct(string_split(p_type, ' ')) AS gnn0, string_split(p_type, ' ') AS gnn, split_part(p_type, ' ', 2) AS graph, CASE WHEN p_size % 5 = 0 THEN ['Profile', 'Comments'] WHEN p_size % 3 = 0 THEN ['Textual', 'Temporal'] ELSE ['Textual', 'Profile'] END AS features, CASE WHEN p_size % 6 = 0 THEN 'Semi' ELSE 'Supervised' END AS setting FROM part),
lo AS (SELECT me.*, dataset, metric, value, l_orderkey, l_linenumber FROM me JOIN rs ON l_partkey = method_id),
ds AS (SELECT DISTINCT dataset AS name, CASE WHEN dataset LIKE 'x%' THEN ['a', 'b', 'c'] ELSE ['a', 'b'] END AS labels, length(dataset) * 100 AS size FROM rs)"""


def methods(spark, d):
    p = c.table(spark, d, "part")
    n = F.col("l_linenumber")
    li = c.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", n, F.when(n > 4, F.concat(F.lit("x"), n)).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("dataset"), F.when(n % 2 == 1, "ACC").otherwise("F1").alias("metric"), F.round(0.3 + F.col("l_tax") * 5 + F.col("l_discount") * 2, 3).alias("value"))
    r = li.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "dataset", "metric", "value"))), lambda x: F.struct(x["dataset"].alias("dataset"), x["metric"].alias("metric"), x["value"].alias("value"))).alias("results"))
    size = F.col("p_size")
    feats = F.when(size % 5 == 0, F.array(F.lit("Profile"), F.lit("Comments"))).when(size % 3 == 0, F.array(F.lit("Textual"), F.lit("Temporal"))).otherwise(F.array(F.lit("Textual"), F.lit("Profile")))
    m = p.select(F.col("p_partkey").alias("method_id"), F.col("p_brand").alias("ref"), (2019 + size % 4).alias("year"), F.split("p_type", " ").alias("gnn"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("graph"), feats.alias("features"), F.when(size % 6 == 0, "Semi").otherwise("Supervised").alias("setting"))
    return m.join(r, m["method_id"] == r["l_partkey"], "left").select("method_id", "ref", "year", "gnn", "graph", "features", "setting", F.coalesce("results", F.array().cast(r.schema["results"].dataType)).alias("results"))


def datasets(spark, d):
    name = F.col("dataset")
    x = literature.long_results(methods(spark, d)).select("dataset").distinct()
    two, three = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return x.select(name.alias("name"), F.when(name.like("x%"), three).otherwise(two).alias("labels"), (F.length(name) * 100).alias("size"))


@query("l1_methods", "method_id:i ref:s year:i gnn:s graph:s features:s datasets:s performance:s", "", SQL + """ SELECT method_id, any_value(ref) AS ref, any_value(year) AS year, array_to_string(any_value(me.gnn), ', ') AS gnn, any_value(graph) AS graph, array_to_string(any_value(features), ', ') AS features,
coalesce(string_agg(dataset, ', ' ORDER BY l_orderkey, l_linenumber, dataset, metric, value), '') AS datasets, coalesce(string_agg(dataset || ' ' || metric || ': ' || printf('%.3f', value), '; ' ORDER BY l_orderkey, l_linenumber, dataset, metric, value), '') AS performance FROM me LEFT JOIN rs ON l_partkey = method_id GROUP BY method_id""")
def _(spark, d):
    return literature.wide_methods(methods(spark, d))


@query("l1_datasets", "dataset:s n_labels:i labels:s size:i", "", SQL + " SELECT name AS dataset, len(labels) AS n_labels, array_to_string(labels, ', ') AS labels, size FROM ds")
def _(spark, d):
    return literature.wide_datasets(datasets(spark, d))


@query("l2_long_results", "method_id:i dataset:s metric:s value:f", "", SQL + " SELECT method_id, dataset, metric, value FROM lo")
def _(spark, d):
    return literature.long_results(methods(spark, d))


@query("l3_mentions", "value:s n:i share:f", "", SQL + " SELECT value, count(*) AS n, count(*) / (SELECT count(*) FROM me) AS share FROM (SELECT unnest(features) AS value FROM me) GROUP BY 1")
def _(spark, d):
    return literature.mentions(methods(spark, d), "features")


@query("l3_year_trend", "year:i n:i so_far:i", "", SQL + " SELECT year, n, sum(n) OVER (ORDER BY year) AS so_far FROM (SELECT year, count(*) AS n FROM me GROUP BY 1)")
def _(spark, d):
    return literature.year_trend(methods(spark, d))


LISTED = "(SELECT string_agg(value || '=' || n, ', ' ORDER BY n DESC, value) FROM {0})"


@query("l4_claims", "claim:s supported:b evidence:s", "", SQL + f""", n AS (SELECT count(*) AS a FROM me), g AS (SELECT value, count(*) AS n FROM (SELECT unnest(gnn) AS value FROM me) GROUP BY 1), gr AS (SELECT graph AS value, count(*) AS n FROM me GROUP BY 1),
fe AS (SELECT value, count(*) AS n FROM (SELECT unnest(features) AS value FROM me) GROUP BY 1), se AS (SELECT setting AS value, count(*) AS n FROM me GROUP BY 1), mc AS (SELECT value FROM lo WHERE metric = 'ACC' AND dataset LIKE 'x%'),
k AS (SELECT (SELECT coalesce(sum(n), 0) FROM gr WHERE value = 'PLATED') AS p, (SELECT coalesce(sum(n), 0) FROM fe WHERE value = 'Textual') AS t, (SELECT coalesce(max(n), 0) FROM fe WHERE value IN ('Comments', 'Temporal')) AS r, (SELECT coalesce(sum(n), 0) FROM se WHERE value = 'Supervised') AS s)
SELECT 'first_year' AS claim, (SELECT min(year) FROM me) = 2019 AS supported, (SELECT min(year) FROM me) || ': ' || (SELECT string_agg(ref, ', ' ORDER BY ref) FROM (SELECT DISTINCT ref FROM me WHERE year = (SELECT min(year) FROM me))) AS evidence
UNION ALL SELECT 'leaders', (SELECT list_sort(list(value)) FROM (SELECT value FROM g ORDER BY n DESC, value LIMIT 2)) = ['STANDARD', 'TIN'], {LISTED.format('g')}
UNION ALL SELECT 'majority_graph', p > a / 2, p || '/' || a || '; ' || {LISTED.format('gr')} FROM k, n
UNION ALL SELECT 'main_feature', t > a / 2 AND r < t / 2, t || '/' || a || '; ' || {LISTED.format('fe')} FROM k, n
UNION ALL SELECT 'setting', s > a / 2, s || '/' || a || '; ' || {LISTED.format('se')} FROM k, n
UNION ALL SELECT 'multiclass_low', count(*) FILTER (WHERE value < 0.5) > count(*) / 2, count(*) FILTER (WHERE value < 0.5) || ' of ' || count(*) || ' below 0.5; median ' || printf('%.3f', median(value)) FROM mc""")
def _(spark, d):
    return literature.verify_claims(methods(spark, d), datasets(spark, d), 2019, ["TIN", "STANDARD"], "PLATED", "Textual", ["Comments", "Temporal"], "Supervised", "ACC")


@query("l5_sizes", "dataset:s printed:i found:i matches:b delta:i", "", SQL + ", n AS (SELECT dataset AS name, count(*) AS n FROM lo WHERE dataset <> 'x5' GROUP BY 1) SELECT name AS dataset, size AS printed, n AS found, n = size AS matches, n - size AS delta FROM ds LEFT JOIN n USING (name)")
def _(spark, d):
    counts = literature.long_results(methods(spark, d)).filter("dataset <> 'x5'").groupBy(F.col("dataset").alias("name")).agg(F.count("*").alias("n"))
    return literature.verify_sizes(datasets(spark, d), counts)


@query("l6_ranges", "dataset:s n:i lo:f hi:f spread:f median:f place:i", "", SQL + ", r AS (SELECT dataset, count(*) AS n, min(value) AS lo, max(value) AS hi, median(value) AS median FROM lo WHERE metric = 'ACC' GROUP BY 1 HAVING count(*) >= 3) SELECT *, hi - lo AS spread, row_number() OVER (ORDER BY median, dataset) AS place FROM r")
def _(spark, d):
    return literature.ranges(literature.long_results(methods(spark, d)), "ACC", 3)


@query("l7_coverage", "dataset:s family:s mean:f n:i families:i", "", SQL + ", r AS (SELECT dataset, gnn[1] AS family, avg(value) AS mean, count(*) AS n FROM lo WHERE metric = 'ACC' GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY dataset) AS families FROM r")
def _(spark, d):
    return literature.coverage(literature.long_results(methods(spark, d)), "ACC")


@query("l7_coverage_grid", "dataset:s STANDARD:f SMALL:f", "", SQL + " SELECT dataset, avg(value) FILTER (WHERE gnn[1] = 'STANDARD') AS STANDARD, avg(value) FILTER (WHERE gnn[1] = 'SMALL') AS SMALL FROM lo WHERE metric = 'ACC' GROUP BY 1")
def _(spark, d):
    return literature.coverage_grid(literature.long_results(methods(spark, d)), "ACC", ["STANDARD", "SMALL"])


@query("l8_against_range", "dataset:s best:f method:s lo:f hi:f inside:b", "", SQL + """, o AS (SELECT dataset, ref AS method, value + 0.02 AS value FROM lo WHERE metric = 'F1'), b AS (SELECT dataset, value, method FROM o QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY value DESC, method) = 1),
p AS (SELECT dataset, min(value) AS lo, max(value) AS hi FROM lo WHERE metric = 'ACC' GROUP BY 1) SELECT dataset, value AS best, method, lo, hi, value BETWEEN lo AND hi AS inside FROM b LEFT JOIN p USING (dataset)""")
def _(spark, d):
    r = literature.long_results(methods(spark, d))
    return literature.against_range(r.filter("metric = 'F1'").select("dataset", F.col("ref").alias("method"), (F.col("value") + 0.02).alias("value")), r, "ACC")


@query("l9_below_baseline", "method_id:i dataset:s value:f gap:f", "", SQL + " SELECT method_id, dataset, value, 0.45 - value AS gap FROM lo WHERE metric = 'ACC' AND value < 0.45")
def _(spark, d):
    return literature.below_baseline(literature.long_results(methods(spark, d)), "ACC", F.lit(0.45))


TREE = """tx AS (SELECT 'r' || r_regionkey AS label, NULL AS parent, r_regionkey AS place, 0 AS refs FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_nationkey % 3 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey % 1000, s_suppkey % 4 FROM supplier),
pt AS (SELECT * FROM (WITH RECURSIVE t(label, depth, path, ord) AS (SELECT label, 0, label, printf('%04d', place) FROM tx WHERE parent IS NULL UNION ALL SELECT x.label, t.depth + 1, t.path || ' > ' || x.label, t.ord || '.' || printf('%04d', x.place) FROM t JOIN tx x ON x.parent = t.label) SELECT * FROM t))"""


def taxonomy(spark, d):
    one = lambda label, parent, place, refs: F.struct(label.alias("label"), parent.alias("parent"), place.cast("int").alias("place"), F.array_repeat(F.lit("ref"), refs.cast("int")).alias("refs"))
    r = c.table(spark, d, "region").select(one(F.concat(F.lit("r"), "r_regionkey"), F.lit(None).cast("string"), F.col("r_regionkey"), F.lit(0)).alias("x"))
    n = c.table(spark, d, "nation").select(one(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey"), F.col("n_nationkey") % 3).alias("x"))
    s = c.table(spark, d, "supplier").select(one(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey") % 1000, F.col("s_suppkey") % 4).alias("x"))
    return r.union(n).union(s).select("x.*")


@query("l10_paths", "label:s depth:i path:s", "", TREE + " SELECT label, depth, path FROM pt")
def _(spark, d):
    return literature.taxonomy_paths(taxonomy(spark, d))


@query("l10_described", "ord:s line:s leaf:b refs:i", "", TREE + " SELECT ord, repeat('    ', depth) || label AS line, label NOT IN (SELECT parent FROM tx WHERE parent IS NOT NULL) AS leaf, refs FROM pt JOIN tx USING (label)")
def _(spark, d):
    return literature.described(taxonomy(spark, d)).withColumnRenamed("order", "ord")


@query("l11_spreads", "dataset:s setting_spread:f graph_spread:f a_wider:b", "", SQL + """, a AS (SELECT dataset, max(m) - min(m) AS s FROM (SELECT dataset, setting, avg(value) AS m FROM lo GROUP BY 1, 2) GROUP BY 1), b AS (SELECT dataset, max(m) - min(m) AS s FROM (SELECT dataset, graph, avg(value) AS m FROM lo GROUP BY 1, 2) GROUP BY 1)
SELECT dataset, a.s AS setting_spread, b.s AS graph_spread, a.s > b.s AS a_wider FROM a FULL JOIN b USING (dataset)""")
def _(spark, d):
    return literature.spreads(literature.long_results(methods(spark, d)), "setting", "graph")
