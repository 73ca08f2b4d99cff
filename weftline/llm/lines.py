"""Line dedup by a fixed-depth log-template tree.

A line's path in the tree is its token count, then its DEPTH leading tokens; tokens with a digit are variable from the
start, and one leading token is too where the path with it has few documents and the one without it has enough. In the
leaf below the path the tokens at each further place are counted over all documents: a token that few documents have there
is a variable field and becomes <*>. So a leaf's templates are its lines with their variable fields generalised, in
whatever order the rows come, and a line whose template recurs across documents is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import boxed, stored, table, text_or_empty, unboxed

#: Leading tokens that the tree branches on below the token count.
DEPTH = 3
#: Documents in which a template must occur to count as recurring; a long line needs fewer.
MIN_DOCS, LONG_TOKENS, LONG_DOCS = 20, 50, 5
#: Share of a template's tokens that must be constant, and that may be words found to vary (tokens with digits aside): a
#: template of fields alone says nothing.
MIN_CONSTANT, MAX_FIELDS = 0.5, 0.2
#: Rows into which the other side of a join on a hot line is multiplied.
SALT = 16
#: Full leaves, 16 bytes each, that are broadcast to the second reading.
BROADCAST_LEAVES = 1_000_000
FIELD = "<*>"


def _folded(line: Column) -> Column:
    """The line with single blanks, and none at its ends."""
    plain = F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")
    uneven = reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\x0b")])
    return F.trim(F.when(uneven, plain).otherwise(line))  # most lines have single blanks already


def _masked(folded: Column) -> Column:
    """A folded line with every token that has a digit as a field."""
    return F.regexp_replace(folded, r"[^ ]*[0-9][^ ]*", FIELD)


def _key(*cols: Column) -> Column:
    """A 128-bit key, so that no two of a corpus's lines meet by chance."""
    return F.md5(F.concat_ws("\n", *cols).cast("binary"))


def _lines(text_col: str) -> Column:
    return F.split(text_or_empty(text_col), "\n", -1)


def _needed(n_tokens: Column, min_docs: int, long_docs: int) -> Column:
    return F.when(n_tokens >= LONG_TOKENS, F.lit(min(min_docs, long_docs))).otherwise(F.lit(min_docs))


def _with_paths(rows: DataFrame) -> DataFrame:
    """[key, id, at, folded, n, field, leaf] of [key, id, text]: the paths of each line that isn't blank.

    A line has its path as it stands (field 0), and with five tokens or more one for each leading token as a field.
    """
    lines = rows.select("key", "id", F.posexplode(_lines("text")).alias("at", "line")).filter(F.col("line").rlike(r"[^ \t\r\f\x0B]")).withColumn("folded", _folded(F.col("line")))
    n = F.octet_length("folded") - F.octet_length(F.replace("folded", F.lit(" "), F.lit(""))) + 1
    split = lines.select("key", "id", "at", "folded", n.alias("n"), F.split(F.substring_index("folded", " ", DEPTH), " ").alias("t"))
    lead = [f"t{i}" for i in range(1, DEPTH + 1)]
    token = lambda i: F.try_element_at("t", F.lit(i))
    led = split.select("key", "id", "at", "folded", "n", *[F.when(token(i).rlike("[0-9]"), FIELD).otherwise(token(i)).alias(f"t{i}") for i in range(1, DEPTH + 1)])

    def path(j: int) -> Column:
        leaf = F.xxhash64("n", F.lit(j), F.concat_ws(" ", *[F.lit(FIELD) if c == f"t{j}" else F.col(c) for c in lead]))
        usual = (F.col(f"t{j}") != FIELD) & (F.col("n") * MAX_FIELDS >= 1) if j else F.lit(True)
        return F.struct(F.lit(j).alias("field"), F.when(usual, leaf).alias("leaf"))

    return led.select("key", "id", "at", "folded", "n", F.inline(F.array(*[path(j) for j in range(DEPTH + 1)]))).filter("leaf IS NOT NULL")


def _in_full_leaves(rows: DataFrame, min_docs: int, long_docs: int) -> DataFrame:
    """[key, id, at, line, masked, n, field, leaf]: lines with a path that enough lines share, once a document and place.

    rows are [key, id, text]. Leaves are counted first and only the full ones are kept; then the lines are read again and
    those on a full path are masked and written. Of a line's full paths the one without a field stands, then the one with
    the most lines.
    """
    full = _with_paths(rows).groupBy("leaf", "n").agg(F.count("*").alias("lines"))
    full = stored(full.filter(F.col("lines") >= _needed(F.col("n"), min_docs, long_docs)).select("leaf", "lines"))
    small = full.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES  # else Spark joins by shuffle
    on_full = _with_paths(rows).join(F.broadcast(full) if small else full, "leaf")
    best = F.max_by(F.struct("folded", "n", "field", "leaf"), F.struct(F.col("field") == 0, "lines", -F.col("field"))).alias("b")
    one = stored(on_full.groupBy("key", "id", "at").agg(best)).select("key", "id", "at", "b.*")
    return stored(one.select("key", "id", "at", _masked(F.col("folded")).alias("masked"), "n", "field", "leaf").withColumn("line", _key(F.col("masked"))))


def templates(found: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """[line, template, n_tokens, n_docs, first]: the lines of recurring templates, from the lines in full leaves.

    Lines are pre-aggregated by key, so a token is counted once a distinct line, weighted by the line's documents. Tokens
    are counted under 64-bit hashes: two that meet can only keep a template from being generalised. n_docs counts the
    template's documents (rows), first is the smallest id (null if none has one).
    """
    tokens = F.split("masked", " ")
    once = found.groupBy("key", "line").agg(F.min("id").alias("id"), F.min("at").alias("at"))
    docs = once.groupBy("line").agg(F.count("*").alias("docs"))
    grown = found.groupBy("line").agg(F.min("masked").alias("masked"), F.min("n").alias("n"), F.min(F.struct("field", "leaf")).alias("p"))
    grown = stored(grown.join(docs, "line").select("line", "masked", "n", "docs", "p.*", F.monotonically_increasing_id().alias("line_no")))
    enough = _needed(F.col("n"), min_docs, long_docs)
    each = grown.select("line_no", "n", "docs", "leaf", F.posexplode(tokens).alias("pos", "token")).filter((F.col("pos") >= DEPTH) & (F.col("token") != FIELD))
    own = each.select("line_no", "n", "docs", "pos", F.xxhash64("leaf", "pos", "token").alias("place"))
    frequent = own.groupBy("place", "n").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= enough).select("place")
    held = own.join(frequent, "place").groupBy("line_no").agg(F.collect_set("pos").alias("held"))
    constant = lambda i: (i < DEPTH) & (i != F.col("field") - 1) | F.array_contains(F.coalesce("held", F.array().cast("array<int>")), i)
    named = grown.join(held, "line_no", "left").withColumn("tokens", F.transform(tokens, lambda x, i: F.when(constant(i), x).otherwise(FIELD)))
    digits, fields = F.size(F.filter(tokens, lambda x: x == FIELD)), F.size(F.filter("tokens", lambda x: x == FIELD))
    fits = (F.col("n") - fields >= MIN_CONSTANT * F.col("n")) & (fields - digits <= MAX_FIELDS * F.col("n"))
    named = stored(named.filter(fits).select("line", "n", F.array_join("tokens", " ").alias("template")))
    # a document counts once a template: of its lines with the template one row is left before the documents are counted
    salted = named.select("line", "n", _key(F.col("template")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("salt"))
    of_docs = once.select("key", "id", "line", F.pmod(F.xxhash64("key"), F.lit(SALT)).alias("salt")).join(salted, ["line", "salt"]).groupBy("t", "n", "key").agg(F.min("id").alias("id"))
    counts = of_docs.groupBy("t", "n").agg(F.count("*").alias("n_docs"), F.min("id").alias("first")).filter(F.col("n_docs") >= enough)
    return named.withColumn("t", _key(F.col("template"))).join(counts.drop("n"), "t").select("line", "template", F.col("n").alias("n_tokens"), "n_docs", "first")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """All columns with text_col replaced by its kept lines, + n_lines BIGINT, n_dropped BIGINT.

    A line is dropped if its template occurs in min_docs or more documents (long_docs for lines of LONG_TOKENS tokens) and
    this is not the first of them (the smallest id; rows that share that id all keep it, and if all ids are null none
    does). Documents are rows; those equal in id and text count once. Blank lines stay. A null text counts as empty, one
    blank line. Very long texts and lines are read whole. Input columns named like an output are replaced, other names
    never clash. An empty table gives an empty result.

    Only lines in leaves that enough lines share are written and counted; joins on a line are salted, so a line in a
    third of all documents is spread; texts are shuffled once, to meet their dropped line numbers.
    """
    own = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text_or_empty(text_col)).cast("binary"))
    rows = docs.select(boxed(docs, text_col), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), own.alias("key"))
    spots = _in_full_leaves(rows.select("key", "id", "text"), min_docs, long_docs)
    found = stored(templates(spots, min_docs, long_docs))
    salted = found.select("line", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("salt"))
    hit = spots.select("key", "id", "at", "line", F.pmod(F.xxhash64("key"), F.lit(SALT)).alias("salt")).join(salted, ["line", "salt"])
    later = ~F.col("id").eqNullSafe(F.col("first")) | F.col("first").isNull()
    dropped = hit.filter(later).groupBy("key").agg(F.collect_set("at").alias("dropped"))
    joined = rows.join(dropped, "key", "left")
    none = F.coalesce("dropped", F.array().cast("array<int>"))
    kept = F.filter(_lines("text"), lambda x, i: ~F.array_contains(none, i))
    return unboxed(joined, docs, {"n_lines": F.size(_lines("text")).cast("long"), "n_dropped": F.size(none).cast("long"), text_col: F.array_join(kept, "\n")}, text_col)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", "text")


OP1_SQL = r"""
WITH src AS (
  SELECT row_number() OVER () AS rn, doc_id, text FROM documents
), l AS (
  SELECT rn, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM src
), m AS (
  SELECT *, regexp_replace(trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l
), d AS (
  SELECT DISTINCT rn, doc_id, masked FROM m WHERE masked <> ''
), k AS (
  SELECT masked, count(*) AS docs, string_split(masked, ' ') AS tokens FROM d GROUP BY masked
), p AS (
  SELECT *, len(tokens) AS n, CASE WHEN len(tokens) >= 50 THEN 5 ELSE 20 END AS need FROM k
), f AS (
  SELECT p.*, j AS field, CASE j WHEN 0 THEN tokens[1:3] WHEN 1 THEN ['<*>'] || tokens[2:3] WHEN 2 THEN [tokens[1], '<*>'] || tokens[3:3] ELSE tokens[1:2] || ['<*>'] END AS lead
  FROM p, range(4) r(j) WHERE j = 0 OR n >= 5 AND tokens[j] <> '<*>'
), s AS (
  SELECT f.*, in_leaf FROM f JOIN (SELECT n, field, lead, count(*) AS in_leaf FROM f JOIN m USING (masked) GROUP BY n, field, lead) USING (n, field, lead)
), g AS (
  SELECT * FROM s WHERE in_leaf >= need QUALIFY row_number() OVER (PARTITION BY masked ORDER BY field > 0, in_leaf DESC, field) = 1
), t AS (
  SELECT masked, n, need, field, lead, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM g
), w AS (
  SELECT masked, n, need, place, token, token <> '<*>' AND (place = field OR place > 3 AND sum(docs) OVER (PARTITION BY n, field, lead, place, token) < need) AS varies FROM t
), x AS (
  SELECT masked, n, need, string_agg(CASE WHEN varies THEN '<*>' ELSE token END, ' ' ORDER BY place) AS template,
         count(*) FILTER (WHERE NOT varies AND token <> '<*>') AS constants, count(*) FILTER (WHERE varies) AS fields FROM w GROUP BY masked, n, need
), v AS (
  SELECT * FROM x WHERE constants >= 0.5 * n AND fields <= 0.2 * n
), r AS (
  SELECT template, need, min(doc_id) AS first FROM v JOIN d USING (masked) GROUP BY template, need HAVING count(DISTINCT rn) >= need
), y AS (
  SELECT m.*, z.first IS NOT NULL AND m.doc_id <> z.first AS gone FROM m LEFT JOIN (SELECT v.masked, r.first FROM v JOIN r USING (template)) z ON m.masked = z.masked
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM y GROUP BY rn, doc_id
"""
