"""Readers of the public formats: message lists, repost files, statement tables, trees, threads, user graphs.

All read through Spark's readers, so a path can be in any store that Spark reaches. Malformed lines, rows and files are
left out as the source formats ask; nothing is inferred.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import written
from weftline.functions.scalars import days_since, has_time, id_time_ms, parsed_time, post_type
from weftline.operators.temporal import to_undirected
from weftline.sources import json_arrays

#: Labels and columns of the statement tables (fixed values).
STATEMENT_LABELS = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"]
STATEMENT_COLUMNS = ["id", "label", "statement", "subject", "speaker", "job", "state", "party", "barely_true_counts", "false_counts", "half_true_counts", "mostly_true_counts", "pants_fire_counts", "context"]
TWEET_LABELS = ["true", "false", "unverified", "non-rumor"]
REPOST = "array<struct<mid:string,uid:string,parent:string,date:string,text:string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def _stem(file: Column) -> Column:
    """A file's name without folders and ending; a folder of parts that Spark wrote counts as one file."""
    return F.regexp_extract(file, r"([^/=]+?)(?:\.[A-Za-z]+)?(?:/part-[^/]*)?$", 1)


def message_list(spark: SparkSession, path: str) -> DataFrame:
    """[src STRING, dst STRING, ts BIGINT] of lines of three blank-separated fields; other lines are left out."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    x = _lines(spark, path).select(f.alias("f")).filter(F.size("f") == 3)
    return x.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"), F.expr("try_cast(f[2] AS BIGINT)").alias("ts")).filter("ts IS NOT NULL")


#: Decoded text and files that a task holds before it passes them on.
HELD_CHARS, HELD_FILES = 4_000_000, 1_000


def lenient_json(spark: SparkSession, path: str, names: str = "") -> DataFrame:
    """[file, text]: whole files decoded as UTF-8, else as GB18030, else null; text is null too if it is no JSON.

    names: a pattern of the paths that are wanted; others are not read.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[str] = []
        held: list[str | None] = []
        size = 0

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(held, pa.string())], ["file", "text"])
            files.clear()
            held.clear()
            return out

        for batch in batches:
            for i, blob in enumerate(batch.column("content")):
                found = None
                for codec in ("utf-8", "gb18030"):
                    try:
                        found = str(blob.as_buffer(), codec)
                        json.loads(found, object_pairs_hook=lambda _: None)  # only checked: no object is kept
                        break
                    except (UnicodeDecodeError, ValueError):
                        found = None
                held.append(found)
                files.append(batch.column("path")[i].as_py())
                size += len(found or "")
                if size >= HELD_CHARS or len(held) >= HELD_FILES:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("_metadata.file_path").rlike(names)).select("path", "content")
    return found.mapInArrow(decode, "file string, text string")


def _reposts(spark: SparkSession, path: str) -> DataFrame:
    """[name, root_uid, pos, mid, uid, parent, ts]: the records of files `<label>_<root mid>_<root uid>.json` in file order."""
    x = lenient_json(spark, path).filter("text IS NOT NULL").select(_stem(F.col("file")).alias("name"), F.from_json("text", REPOST).alias("r"))
    rows = x.select("name", F.element_at(F.split("name", "_"), -1).alias("root_uid"), F.posexplode("r").alias("pos", "r")).select("name", "root_uid", "pos", "r.*")
    return rows.withColumn("ts", F.unix_seconds(F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss"))))


def repost_edges(spark: SparkSession, path: str) -> DataFrame:
    """[src, dst, ts]: who was reposted to who reposted. A blank or unknown parent is the file's root user; a mid's last
    record gives its user; records without user or readable date, and loops, are left out."""
    r = _reposts(spark, path)
    users = r.filter("mid IS NOT NULL AND mid <> ''").groupBy("name", F.col("mid").alias("parent")).agg(F.max_by("uid", "pos").alias("known"))
    x = r.filter("uid IS NOT NULL AND uid <> '' AND ts IS NOT NULL").join(users, ["name", "parent"], "left")
    return x.select(F.coalesce("known", "root_uid").alias("src"), F.col("uid").alias("dst"), "ts").filter("src <> dst")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """[id, statement, label, subject, speaker, job, state, party, context, split, credit ARRAY<INT>] of `<split>.tsv` files.

    Fields are cut at tabs alone, so quotes stay as they are; rows of under 14 fields or with another label are left out;
    blank counts are 0.
    """
    x = _lines(spark, path).select(_stem(F.col("file")).alias("split"), F.split("value", "\t", -1).alias("f")).filter(F.size("f") >= len(STATEMENT_COLUMNS))
    named = x.select("split", *[F.col("f")[i].alias(c) for i, c in enumerate(STATEMENT_COLUMNS)]).filter(F.col("label").isin(STATEMENT_LABELS))
    counts = F.array(*[F.coalesce(F.expr(f"try_cast(nullif({c}, '') AS INT)"), F.lit(0)) for c in STATEMENT_COLUMNS[8:13]])
    return named.select("id", "statement", "label", "subject", "speaker", "job", "state", "party", "context", "split", counts.alias("credit"))


_TREE_LINE = r"^\['([^']*)', '([^']*)', '([^']*)'\]->\['([^']*)', '([^']*)', '([^']*)'\]$"


def _tree_labels(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, f"{path}/label.txt").filter("value LIKE '%:%'").select(F.substring_index(F.trim("value"), ":", 1).alias("label"), F.regexp_extract(F.trim("value"), "^[^:]*:(.*)$", 1).alias("item_id"))


def _tree_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(f"{path}/tree", wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("item_id"), "value")


def tree_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of tweet_trees, without its nodes and edges."""
    texts = _lines(spark, f"{path}/source_tweets.txt").filter(F.col("value").contains("\t")).select(F.substring_index("value", "\t", 1).alias("item_id"), F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1).alias("text"))
    has_tree = _tree_files(spark, path).select("item_id").distinct()
    return _tree_labels(spark, path).join(has_tree, "item_id", "left_semi").join(texts, "item_id", "left").select("item_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def tweet_trees(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items [item_id, text, label], nodes [item_id, node, uid, tid, delay_min], edges [item_id, parent, child]).

    From label.txt (`label:id`), source_tweets.txt (`id<tab>text`) and tree/<id>.txt. A node is a tweet id; its first
    mention in file order (parent before child) gives user, delay and number. A ROOT line only makes its child; loops are
    left out; labels without a tree file are left out; a missing text is empty.
    """
    labels = _tree_labels(spark, path)
    whole = _tree_files(spark, path).select("item_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    part = lambda i: F.regexp_extract(F.trim("value"), _TREE_LINE, i)
    rows = whole.filter(F.trim("value").rlike(_TREE_LINE)).select("item_id", "line", *[part(i).alias(c) for i, c in enumerate(["pu", "pt", "pd", "cu", "ct", "cd"], 1)])
    rows = written(rows.join(labels.select("item_id").distinct(), "item_id", "left_semi"))
    mention = lambda u, t, d, side: F.struct(F.col(u).alias("uid"), F.col(t).alias("tid"), F.col(d).cast("double").alias("delay_min"), F.lit(side).alias("side"))
    both = F.when(F.col("pu") == "ROOT", F.array(mention("cu", "ct", "cd", 1))).otherwise(F.array(mention("pu", "pt", "pd", 0), mention("cu", "ct", "cd", 1)))
    said = rows.select("item_id", "line", F.explode(both).alias("m")).select("item_id", "line", "m.*")
    first = said.groupBy("item_id", "tid").agg(F.min_by(F.struct("uid", "delay_min", "line", "side"), F.struct("line", "side")).alias("f")).select("item_id", "tid", "f.*")
    number = F.row_number().over(Window.partitionBy("item_id").orderBy("line", "side")) - 1  # one file
    nodes = written(first.withColumn("node", number).select("item_id", "node", "uid", "tid", "delay_min"))
    at = nodes.select("item_id", "tid", "node")
    edges = rows.filter("pu <> 'ROOT' AND pt <> ct").join(at.withColumnsRenamed({"tid": "pt", "node": "parent"}), ["item_id", "pt"]).join(at.withColumnsRenamed({"tid": "ct", "node": "child"}), ["item_id", "ct"])
    return tree_items(spark, path), nodes, edges.select("item_id", "parent", "child")


USER = "struct<followers_count:double,friends_count:double,statuses_count:double,listed_count:double,verified:boolean,description:string,id_str:string>"
TWEET = f"struct<id_str:string,text:string,created_at:string,in_reply_to_status_id_str:string,user:{USER}>"


def _profile(user: Column) -> Column:
    from weftline.operators.summaries import profile_block

    return profile_block(*[user[c] for c in ("followers_count", "friends_count", "statuses_count", "listed_count", "verified", "description")])


def _thread_files(spark: SparkSession, path: str, names: str) -> DataFrame:
    """[event, kind, item_id, folder, name, text] of the files whose path has names in it."""
    place = r"([^/=]+)/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([^/=]+)/(?:(?:[^/=]+=)?(source-tweets|reactions|thread)/)?(?:[^/=]+=)?([^/=]+)\.json(?:/part-[^/]*)?$"
    part = lambda i: F.regexp_extract("file", place, i)
    files = lenient_json(spark, path, names).filter("text IS NOT NULL")
    return files.select(*[part(i).alias(c) for i, c in enumerate(["event", "kind", "item_id", "folder", "name"], 1)], "text")


def _tweets(spark: SparkSession, path: str) -> DataFrame:
    """[event, kind, item_id, source] and the fields of TWEET, written: every table of threads reads them, and files are parsed once."""
    tweets = _thread_files(spark, path, "source-tweets|reactions").filter("folder IN ('source-tweets', 'reactions')").select("event", "kind", "item_id", "folder", F.explode(F.from_json("text", f"array<{TWEET}>")).alias("t")).filter("t.id_str IS NOT NULL")
    tweets = tweets.select("event", "kind", "item_id", (F.col("folder") == "source-tweets").alias("source"), "t.*").dropDuplicates(["item_id", "id_str"])
    return written(tweets.withColumn("time", F.unix_seconds(parsed_time(F.col("created_at")))))


def _starts(tweets: DataFrame) -> DataFrame:
    return tweets.filter("source").groupBy("item_id").agg(F.min("time").alias("t0"), F.min("event").alias("event"), F.min("kind").alias("kind"), F.min_by("text", "id_str").alias("text"))


def thread_items(spark: SparkSession, path: str, tweets: DataFrame | None = None) -> DataFrame:
    """The items of threads, without its nodes and edges."""
    from weftline.operators.summaries import veracity

    notes = _thread_files(spark, path, "annotation").filter("name = 'annotation'").select("item_id", F.from_json("text", "map<string,string>").alias("a"))
    whole = lambda k: F.expr(f"try_cast(a['{k}'] AS INT)")
    label = notes.select("item_id", veracity(whole("misinformation"), whole("true")).alias("label"))
    return _starts(_tweets(spark, path) if tweets is None else tweets).join(label, "item_id", "left").select("item_id", "event", "kind", "text", "label")


def threads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items [item_id, event, kind, text, label], nodes [item_id, node, uid, delay_min, profile, tid], edges [item_id, parent, child]).

    From event/kind/thread/{source-tweets,reactions}/*.json with structure.json and annotation.json; a file of tweets holds
    one tweet or an array of them. Nodes are the source
    tweet, then the reactions by id; delays are minutes after the source. Edges come from the nested keys of structure.json
    or, where these give none, from the replied-to ids. The label is the veracity of the annotation.
    """
    tweets = _tweets(spark, path)
    start = _starts(tweets)
    number = F.row_number().over(Window.partitionBy("item_id").orderBy(~F.col("source"), "id_str")) - 1  # one thread
    nodes = written(tweets.join(start.select("item_id", "t0"), "item_id").select("item_id", number.alias("node"), F.col("user.id_str").alias("uid"), ((F.col("time") - F.col("t0")) / 60).alias("delay_min"), _profile(F.col("user")).alias("profile"), F.col("id_str").alias("tid"), F.col("in_reply_to_status_id_str").alias("reply_to")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                todo = [(k, v) for k, v in json.loads(text).items()] if text.lstrip().startswith("{") else []
                while todo:
                    above, below = todo.pop()
                    for k, v in below.items() if isinstance(below, dict) else ():
                        out.append((item, above, k))
                        todo.append((k, v))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], ["item_id", "pt", "ct"])

    nested = written(_thread_files(spark, path, "structure").filter("name = 'structure'").select("item_id", "text").mapInArrow(walk, "item_id string, pt string, ct string"))
    at = nodes.select("item_id", "tid", "node")
    placed = lambda e: e.join(at.withColumnsRenamed({"tid": "pt", "node": "parent"}), ["item_id", "pt"]).join(at.withColumnsRenamed({"tid": "ct", "node": "child"}), ["item_id", "ct"]).filter("parent <> child").select("item_id", "parent", "child").distinct()
    tree = placed(nested)
    replies = placed(nodes.select("item_id", F.col("reply_to").alias("pt"), F.col("tid").alias("ct"))).join(tree.select("item_id").distinct(), "item_id", "left_anti")
    return thread_items(spark, path, tweets), nodes.drop("reply_to"), tree.unionByName(replies)


def repost_cascades(spark: SparkSession, reposts: str, originals: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items [item_id, text, label], nodes [item_id, node, uid, delay_min, profile], edges [item_id, parent, child]) of files in both folders.

    Node 0 is the original post, node i the file's i-th record. A blank or unknown parent is node 0; a mid's last record
    counts. Delays run from the earliest known time in the file, unknown ones are 0. The author's profile goes to every
    node; `user` may be a bare name.
    """
    from weftline.operators.summaries import profile_block

    author = "struct<followers:double,friends:double,messages:double,verified:boolean,description:string>"
    posts = lenient_json(spark, originals).filter("text IS NOT NULL").select(_stem(F.col("file")).alias("item_id"), F.get_json_object("text", "$.text").alias("text"), F.from_json(F.get_json_object("text", "$.user"), author).alias("u"), F.unix_seconds(F.try_to_timestamp(F.get_json_object("text", "$.date"), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("t"))
    profile = profile_block(F.col("u.followers"), F.col("u.friends"), F.col("u.messages"), F.lit(0), F.col("u.verified"), F.col("u.description"))
    r = _reposts(spark, reposts).withColumnRenamed("name", "item_id").join(posts.select("item_id"), "item_id", "left_semi")
    both = posts.join(r.select("item_id").distinct(), "item_id", "left_semi")
    root = both.select("item_id", F.lit(0).alias("node"), F.element_at(F.split("item_id", "_"), -1).alias("uid"), F.col("t").alias("ts"))
    rest = r.select("item_id", (F.col("pos") + 1).alias("node"), "uid", "ts")
    t0 = rest.unionByName(root).groupBy("item_id").agg(F.min("ts").alias("t0"))
    nodes = root.unionByName(rest).join(t0, "item_id").join(both.select("item_id", profile.alias("profile")), "item_id")
    nodes = nodes.select("item_id", "node", "uid", F.coalesce((F.col("ts") - F.col("t0")) / 60, F.lit(0.0)).alias("delay_min"), "profile")
    at = r.filter("mid IS NOT NULL AND mid <> ''").groupBy("item_id", F.col("mid").alias("parent_mid")).agg((F.max("pos") + 1).alias("parent"))
    linked = r.select("item_id", F.col("parent").alias("parent_mid"), (F.col("pos") + 1).alias("child")).join(at, ["item_id", "parent_mid"], "left")
    edges = linked.select("item_id", F.coalesce("parent", F.lit(0)).alias("parent"), "child").filter("parent <> child")
    label = F.when(F.substring_index("item_id", "_", 1).rlike("^(rumor|0*1)"), "rumor").otherwise("non-rumor")
    return both.select("item_id", "text", label.alias("label")), nodes, edges


METRICS = "struct<tweet_count:double,followers_count:double,following_count:double,listed_count:double>"
NODE = f"id string, created_at string, text string, public_metrics {METRICS}"


def user_graph(spark: SparkSession, path: str, reference: str = "2015-01-01", with_posts: bool = True) -> dict[str, DataFrame]:
    """users [user_id, features ARRAY<DOUBLE>, label, split], edges [src, dst] undirected, posts [user_id, post_id, text].

    From label.csv, split.csv, edge.csv and node.json. Users are the labelled ones and all ends of user-user relations
    (ids that start with u), whose kinds are merged; features are tweets, followers, following, listed and account age in
    days, 0 without metadata; unlabelled users have a null label. Posts are non-empty texts of labelled authors.
    """
    csv = lambda name: spark.read.csv(f"{path}/{name}.csv", header=True)
    labels = csv("label").select(F.col("id").alias("user_id"), (F.col("label") == "bot").cast("int").alias("label"))
    splits = csv("split").select(F.col("id").alias("user_id"), "split")
    rel = csv("edge")
    between = rel.filter("relation <> 'post' AND source_id LIKE 'u%' AND target_id LIKE 'u%'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    nodes = json_arrays.records(spark, f"{path}/node.json", NODE)
    m = lambda c: F.coalesce(F.col(f"public_metrics.{c}"), F.lit(0.0))
    age = days_since(parsed_time(F.col("created_at")), reference).cast("double")
    known = nodes.filter("id LIKE 'u%'").select(F.col("id").alias("user_id"), F.array(m("tweet_count"), m("followers_count"), m("following_count"), m("listed_count"), age).alias("features"))
    ids = labels.select("user_id").union(between.select("src")).union(between.select("dst")).distinct()
    users = ids.join(known, "user_id", "left").join(labels, "user_id", "left").join(splits, "user_id", "left").select("user_id", F.coalesce("features", F.array_repeat(F.lit(0.0), 5)).alias("features"), "label", "split")
    out = {"users": users, "edges": to_undirected(between)}
    if with_posts:
        wrote = rel.filter("relation = 'post'").select(F.col("source_id").alias("user_id"), F.col("target_id").alias("post_id")).join(labels.select("user_id"), "user_id", "left_semi")
        texts = nodes.filter("id LIKE 't%' AND text IS NOT NULL AND text <> ''").select(F.col("id").alias("post_id"), "text")
        out["posts"] = wrote.join(texts, "post_id").select("user_id", "post_id", "text")
    return out


def labelled_users(spark: SparkSession, path: str, max_users: int | None = None, reference: str = "2022-01-01") -> DataFrame:
    """[user_id, features, label, split] of label.csv joined with user.json; without that file, zero features.

    max_users keeps that many of the labelled users, the smallest ids first.
    """
    labels = spark.read.csv(f"{path}/label.csv", header=True).select(F.col("id").alias("user_id"), (F.col("label") == "bot").cast("int").alias("label"))
    splits = spark.read.csv(f"{path}/split.csv", header=True).select(F.col("id").alias("user_id"), "split")
    rows = labels.join(splits, "user_id", "left")
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/user.json")
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        out = rows.withColumn("features", F.array_repeat(F.lit(0.0), 5))
    else:
        m = lambda c: F.coalesce(F.col(f"public_metrics.{c}"), F.lit(0.0))
        known = json_arrays.records(spark, f"{path}/user.json", NODE).select(F.col("id").alias("user_id"), F.array(m("tweet_count"), m("followers_count"), m("following_count"), m("listed_count"), days_since(parsed_time(F.col("created_at")), reference).cast("double")).alias("features"))
        out = rows.join(known, "user_id")
    out = out.select("user_id", "features", "label", "split")
    return out.orderBy("user_id").limit(max_users) if max_users is not None else out


def account_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events [account_id, tweet_id, ts_ms, post_type], accounts [account_id, label, created_ms, dropped]) of a user graph's files.

    Posts of labelled accounts whose id carries a time, which is decoded; the others are counted as dropped. Accounts
    without events stay.
    """
    labels = spark.read.csv(f"{path}/label.csv", header=True).select(F.col("id").alias("account_id"), (F.col("label") == "bot").cast("int").alias("label"))
    nodes = json_arrays.records(spark, f"{path}/node.json", NODE)
    wrote = spark.read.csv(f"{path}/edge.csv", header=True).filter("relation = 'post'").select(F.col("source_id").alias("account_id"), F.col("target_id").alias("post_id"))
    texts = nodes.filter("id LIKE 't%'").select(F.col("id").alias("post_id"), "text")
    number = F.expr("try_cast(regexp_replace(post_id, '^t', '') AS BIGINT)")
    all_posts = wrote.join(labels.select("account_id"), "account_id", "left_semi").join(texts, "post_id", "left").select("account_id", number.alias("tweet_id"), post_type(F.col("text")).alias("post_type"))
    timed = has_time(F.col("tweet_id"))
    events = all_posts.filter(timed).select("account_id", "tweet_id", id_time_ms(F.col("tweet_id")).alias("ts_ms"), "post_type")
    dropped = all_posts.groupBy("account_id").agg(F.count_if(~F.coalesce(timed, F.lit(False))).alias("dropped"))
    created = nodes.filter("id LIKE 'u%'").select(F.col("id").alias("account_id"), F.unix_millis(parsed_time(F.col("created_at"))).alias("created_ms"))
    accounts = labels.join(created, "account_id", "left").join(dropped, "account_id", "left").select("account_id", "label", "created_ms", F.coalesce("dropped", F.lit(0)).alias("dropped"))
    return events, accounts


def user_vectors(spark: SparkSession, path: str) -> DataFrame:
    """[user_id, properties ARRAY<DOUBLE>, vec ARRAY<FLOAT>, label, split] from Parquet tables vectors and labels; dev becomes val."""
    v, lab = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/labels")
    return v.join(lab, "user_id", "left").withColumn("split", F.when(F.col("split") == "dev", "val").otherwise(F.col("split")))


READERS = {"messages": message_list, "reposts": repost_edges, "statements": statements, "trees": tweet_trees, "threads": threads, "repost_cascades": repost_cascades, "user_graph": user_graph, "labelled_users": labelled_users, "account_events": account_events, "user_vectors": user_vectors}


def load(name: str, spark: SparkSession, *args, **options):
    """The named format's reader; an unknown name is an error."""
    if name not in READERS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(READERS)}")
    return READERS[name](spark, *args, **options)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """[name, n] of named tables."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])
