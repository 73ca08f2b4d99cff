"""The canonical tables, derived from the supplied ones, and the same derivations as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import SNOWFLAKE_EPOCH_MS
from weftline.functions.segments import stepped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(col: str):
    return F.expr(f"unix_millis(CAST({col} AS TIMESTAMP))")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[src, dst, ts]: customer to supplier at the order's time in epoch seconds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), F.expr("unix_seconds(CAST(o_orderdate AS TIMESTAMP))").alias("ts"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 1_000_000).alias("dst"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("src", "dst", "ts")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[post_id, account_id, ts_ms, event_type, value, tweet_id, item_id]: an event a post; every 40th id carries no time."""
    ms = _ms("ts")
    timed = F.shiftleft(ms - SNOWFLAKE_EPOCH_MS, 22) + F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"), F.col("user_id").alias("account_id"), ms.alias("ts_ms"), "event_type", "value",
        F.when(F.col("event_id") % 40 == 0, F.col("event_id")).otherwise(timed).alias("tweet_id"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("item_id"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[account_id, label, created_ms]."""
    a = F.col("account_id")
    first = posts(spark, sf_dir).groupBy("account_id").agg(F.min("ts_ms").alias("first"))
    late = F.when(a % 10 == 7, 86_400_000).otherwise(0)
    return first.select("account_id", F.when(a % 3 == 0, 1).otherwise(0).alias("label"), (F.col("first") - a % 5 * 86_400_000 + late).alias("created_ms"))


def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[src, dst, ts]: each event to the event before it on the same item; can hold loops."""
    p = stepped(posts(spark, sf_dir).select("item_id", "ts_ms", "post_id", "account_id"), ["item_id"], ["ts_ms", "post_id"], before={"dst": "account_id"})
    return p.filter("dst IS NOT NULL").select(F.col("account_id").alias("src"), "dst", F.floor(F.col("ts_ms") / 1000).alias("ts"))


def cascade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[item_id, node, uid, delay_min, value, post_id]: the item's events in order, node 0 the source."""
    p = posts(spark, sf_dir).select("item_id", "ts_ms", "post_id", "account_id", "value")
    p = stepped(p, ["item_id"], ["ts_ms", "post_id"], number="node", first={"start": "ts_ms"})
    return p.select("item_id", F.col("node").cast("int").alias("node"), F.col("account_id").alias("uid"), ((F.col("ts_ms") - F.col("start")) / 60_000).alias("delay_min"), "value", "post_id")


def cascade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[item_id, parent, child]: a recursive tree; node i hangs below node post_id mod i."""
    return cascade_nodes(spark, sf_dir).filter("node > 0").select("item_id", parent().alias("parent"), F.col("node").alias("child"))


def parent():
    """The parent of a cascade node other than the first."""
    return (F.col("post_id") % F.col("node")).cast("int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[item_id, text, label, group]: documents with their quality label, null where unlabelled."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("item_id"), "text", "label", F.col("source").alias("group"), "lang")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[id, label, score]: accounts with a score in [0, 1] that has ties."""
    a = F.col("account_id")
    return accounts(spark, sf_dir).select(a.alias("id"), "label", ((a * 37 % 101 + 40 * F.col("label")) % 101 / 100).alias("score"))


#: DuckDB definitions of the same tables, by name; later ones may use earlier ones.
SQL = {
    "interactions": "SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, epoch(o_orderdate)::BIGINT AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "posts": """SELECT event_id AS post_id, user_id AS account_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value,
        CASE WHEN event_id % 40 = 0 THEN event_id ELSE (((epoch_us(ts) // 1000) - 1288834974657) << 22) + event_id END AS tweet_id,
        regexp_extract(props, '[0-9]+')::INTEGER AS item_id FROM events""",
    "accounts": """SELECT account_id, CASE WHEN account_id % 3 = 0 THEN 1 ELSE 0 END AS label,
        min(ts_ms) - account_id % 5 * 86400000 + CASE WHEN account_id % 10 = 7 THEN 86400000 ELSE 0 END AS created_ms FROM posts GROUP BY account_id""",
    "reply_edges": """SELECT account_id AS src, dst, ts_ms // 1000 AS ts FROM (
        SELECT *, lag(account_id) OVER (PARTITION BY item_id ORDER BY ts_ms, post_id) AS dst FROM posts) WHERE dst IS NOT NULL""",
    "cascade_nodes": """SELECT item_id, (row_number() OVER w - 1)::INTEGER AS node, account_id AS uid, (ts_ms - first(ts_ms) OVER w) / 60000.0 AS delay_min, value, post_id
        FROM posts WINDOW w AS (PARTITION BY item_id ORDER BY ts_ms, post_id)""",
    "cascade_edges": "SELECT item_id, (post_id % node)::INTEGER AS parent, node AS child FROM cascade_nodes WHERE node > 0",
    "items": "SELECT d.doc_id AS item_id, text, quality AS label, source AS \"group\", lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "scores": "SELECT account_id AS id, label, ((account_id * 37 % 101 + 40 * label) % 101) / 100.0 AS score FROM accounts",
}
_NEEDS = {"accounts": ["posts"], "reply_edges": ["posts"], "cascade_nodes": ["posts"], "cascade_edges": ["posts", "cascade_nodes"], "scores": ["posts", "accounts"]}


def with_tables(sql: str, *names: str) -> str:
    """The query with WITH clauses for the named canonical tables; sql starts with further `name AS (...),` or SELECT."""
    wanted = dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n])
    ctes = [f"{n} AS ({SQL[n]})" for n in wanted]
    body = sql.strip()
    rest = "" if body.upper().startswith("SELECT") else ", "
    if not ctes:
        return body if not rest else f"WITH {body}"
    return f"WITH {', '.join(ctes)}{rest or ' '}{body}"
