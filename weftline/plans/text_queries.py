"""Queries on texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.scalars import STOP_WORDS, cleaned_words, post_type
from weftline.operators import text
from weftline.plans.base import query
from weftline.sources import canonical as c

TEXTS = "tx AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'RT @a: ' || text WHEN 1 THEN '@b ' || text WHEN 2 THEN text || ' https://t.co/x1 ' ELSE text END AS text FROM conversations)"


def tweets(spark, d):
    t = c.table(spark, d, "conversations")
    k = F.col("turn") % 4
    body = F.when(k == 0, F.concat(F.lit("RT @a: "), "text")).when(k == 1, F.concat(F.lit("@b "), "text")).when(k == 2, F.concat("text", F.lit(" https://t.co/x1 "))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", body.alias("text"))


@query("f4_post_type", "conv_id:i turn:i kind:i", "", TEXTS + r""" SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 0 WHEN regexp_matches(text, '^\s*RT\s+@[\p{L}\p{N}_]+') THEN 2 WHEN regexp_matches(text, '^\s*@[\p{L}\p{N}_]+') THEN 1 WHEN regexp_matches(text, 'https?://t\.co/[\p{L}\p{N}_]+\s*$') THEN 3 ELSE 0 END AS kind FROM tx""")
def _(spark, d):
    return tweets(spark, d).select("conv_id", "turn", post_type(F.col("text")).alias("kind"))


@query("f8_clean_text", "conv_id:i turn:i cleaned:s", "", TEXTS + r""" SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
'http[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+', ' ', 'g'), '[@#][\p{L}\p{N}_]+', ' ', 'g'), '[^\x00-\x7F]+', ' ', 'g'), '[^a-z \t\n\r\f\x0B]', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')), ' '),
lambda w: w <> '' AND NOT list_contains([""" + ", ".join(f"'{w}'" for w in STOP_WORDS if "'" not in w) + "], w)), ' ') AS cleaned FROM tx")
def _(spark, d):
    return tweets(spark, d).select("conv_id", "turn", cleaned_words(F.col("text")).alias("cleaned"))


PRONOUNS = "len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains([{}], lower(w)))) / n"


@query("f10_style", "item_id:i n_words:i mean_word:f dots:f questions:f shouts:f commas:f capitals:f digits:f first_person:f third_person:f", "items", r"""
w AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS ws FROM items),
n AS (SELECT *, len(ws) AS n, length(text)::DOUBLE AS ch FROM w)
SELECT item_id, n AS n_words, coalesce(length(array_to_string(ws, '')) / nullif(n, 0), 0) AS mean_word, (length(text) - length(replace(text, '.', ''))) / ch AS dots, (length(text) - length(replace(text, '?', ''))) / ch AS questions,
(length(text) - length(replace(text, '!', ''))) / ch AS shouts, (length(text) - length(replace(text, ',', ''))) / ch AS commas, len(regexp_extract_all(text, '\p{Lu}')) / ch AS capitals, len(regexp_extract_all(text, '\p{Nd}')) / ch AS digits,
""" + PRONOUNS.format(", ".join(f"'{p}'" for p in text.FIRST_PERSON)) + " AS first_person, " + PRONOUNS.format(", ".join(f"'{p}'" for p in text.THIRD_PERSON)) + " AS third_person FROM n")
def _(spark, d):
    return text.style(c.items(spark, d))


@query("f9_cjk_share", "share:f", "items", "SELECT sum(len(regexp_extract_all(text, '[一-鿿]'))) / sum(length(text)) AS share FROM items")
def _(spark, d):
    return text.cjk_share(c.items(spark, d))


TF_IDF = """tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM conversations WHERE conv_id % 5 <> 0),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE item_id // 100 % 5 <> 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 5000),
r AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n)
SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM r"""


def turns(spark, d):
    return c.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "text", "conv_id")


@query("x1_tf_idf", "item_id:i term:s weight:f", "", r"""w AS (SELECT conv_id * 100 + turn AS item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS ws FROM conversations),
t AS (SELECT item_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w), """ + TF_IDF)
def _(spark, d):
    return text.tf_idf(turns(spark, d), F.col("conv_id") % 5 != 0)


@query("x1_char_grams", "item_id:i term:s weight:f", "", r"""w AS (SELECT conv_id * 100 + turn AS item_id, ' ' || unnest(regexp_extract_all(strip_accents(lower(text)), '[^ \t\n\r\f\x0B]+')) || ' ' AS p FROM conversations),
t AS (SELECT item_id, unnest(list_concat(list_transform(range(1, length(p)), lambda i: substr(p, i, 2)), list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) AS term FROM w), """ + TF_IDF)
def _(spark, d):
    return text.tf_idf(turns(spark, d), F.col("conv_id") % 5 != 0, terms=text.CHAR_TERMS)


@query("f9_is_cjk", "cjk:b", "", "SELECT sum(len(regexp_extract_all(text, '[一-鿿]'))) / (sum(length(text)) + count(*) - 1) > 0.1 AS cjk FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200)")
def _(spark, d):
    return text.is_cjk(c.table(spark, d, "documents"), "doc_id")


@query("x4_vector_means", "label:i pos:i mean:f", "", "SELECT label, pos - 1 AS pos, avg(x) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def _(spark, d):
    return text.vector_means(c.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec")), "label")


@query("a16_diagnostics", "zero_rows:i mean_norm:f mean_sd:f", "", """n AS (SELECT sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS n FROM embeddings),
s AS (SELECT pos, stddev_pop(x) AS sd FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)
SELECT (SELECT count(*) FROM n WHERE n = 0) AS zero_rows, (SELECT avg(n) FROM n) AS mean_norm, avg(sd) AS mean_sd FROM s""")
def _(spark, d):
    return text.diagnostics(c.table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")))


@query("x7_skip_grams", "centre:i context:i n:i noise:f", "posts", """t AS (SELECT account_id AS walk, item_id AS node, row_number() OVER (PARTITION BY account_id ORDER BY ts_ms, post_id) AS step FROM posts),
p AS (SELECT a.node AS centre, b.node AS context, count(*) AS n FROM t a JOIN t b ON a.walk = b.walk AND b.step <> a.step AND abs(b.step - a.step) <= 2 GROUP BY 1, 2),
r AS (SELECT node AS context, pow(count(*), 0.75) AS r FROM t GROUP BY 1)
SELECT centre, context, n, r / (SELECT sum(r) FROM r) AS noise FROM p JOIN r USING (context)""")
def _(spark, d):
    t = c.posts(spark, d).select(F.col("account_id").alias("walk"), F.struct("ts_ms", "post_id").alias("step"), F.col("item_id").alias("node"))
    return text.skip_gram_noise(t)


@query("l3_value_counts", "lang:s n:i share:f", "", "SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang")
def _(spark, d):
    x = c.table(spark, d, "documents")
    total = x.agg(F.count("*").alias("all"))
    return x.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(total), how="cross").withColumn("share", F.col("n") / F.col("all"))  # one row
