"""Text features: style, TF-IDF, vector means, skip-grams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import written
from weftline.functions.scalars import ratio

#: Pronouns that are counted (fixed values).
FIRST_PERSON = ["i", "me", "my", "mine", "we", "us", "our", "ours"]
THIRD_PERSON = ["he", "him", "his", "she", "her", "hers", "they", "them", "their"]


def style(items: DataFrame, text: str = "text") -> DataFrame:
    """items + words, mean word length, shares of marks, capitals and digits of all characters, pronoun rates.

    The text is cut into runs of word characters once; a pronoun is such a run, whatever its case.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = items.withColumns({"_t": t, "_words": F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), "_runs": F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))})
    t, words, n, chars = F.col("_t"), F.col("_words"), F.size("_words"), F.length("_t")
    mark = lambda c: ratio(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))), chars)
    of = lambda pattern: ratio(F.regexp_count(t, F.lit(pattern)), chars)
    rate = lambda people: ratio(F.size(F.filter("_runs", lambda w: w.isin(people))), n)
    return cut.withColumns({
        "n_words": n, "mean_word": ratio(F.length(F.array_join(words, "")), n), "dots": mark("."), "questions": mark("?"), "shouts": mark("!"), "commas": mark(","),
        "capitals": of(r"\p{Lu}"), "digits": of(r"\p{Nd}"), "first_person": rate(FIRST_PERSON), "third_person": rate(THIRD_PERSON),
    }).drop("_t", "_words", "_runs")


def is_cjk(items: DataFrame, order: str, text: str = "text", sample: int = 200, share: float = 0.1) -> DataFrame:
    """[cjk]: whether over a tenth of the characters of the first 200 texts, joined by blanks, lie in U+4E00 to U+9FFF."""
    first = items.orderBy(order).limit(sample).agg(F.sum(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"))).alias("k"), (F.sum(F.length(F.coalesce(text, F.lit("")))) + F.count("*") - 1).alias("n"))
    return first.select((ratio(F.col("k"), F.col("n")) > share).alias("cjk"))


def cjk_share(items: DataFrame, text: str = "text") -> DataFrame:
    """[share]: of all characters those in U+4E00 to U+9FFF."""
    return items.agg(ratio(F.sum(F.regexp_count(text, F.lit("[一-鿿]"))), F.sum(F.length(text))).alias("share"))


def _plain_letters() -> tuple[str, str]:
    """Accented letters and what is left of each without its marks, for translate."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x386, 0x3D0), *range(0x400, 0x480)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(i):
            pairs.append((chr(i), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _bare(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *_plain_letters())


def word_tokens(text: Column) -> Column:
    """ARRAY: lower-cased, accent-free runs of two or more word characters."""
    return F.regexp_extract_all(_bare(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def padded_words(text: Column) -> Column:
    """ARRAY: lower-cased, accent-free words between blanks, padded by one blank on each side."""
    words = F.filter(F.split(_bare(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def _runs_up_to(parts: Column, most: int, between: str) -> list[Column]:
    """For n = 1 to most the array of all runs of n neighbours, joined; each is the one before with one more neighbour."""
    out = [parts]
    for n in range(2, most + 1):
        rest = F.greatest(F.size(parts) - n + 1, F.lit(0))
        out.append(F.zip_with(F.slice(out[-1], F.lit(1), rest), F.slice(parts, F.lit(n), rest), lambda a, b: F.concat(a, F.lit(between), b)))
    return out


def word_grams(tokens: Column, most: int = 2) -> Column:
    """ARRAY: the tokens and runs of up to `most` of them joined by a blank."""
    return F.concat(*_runs_up_to(tokens, most, " "))


def char_grams(padded: Column, least: int = 2, most: int = 3) -> Column:
    """ARRAY: runs of 2 to 3 characters inside padded words; a padded word shorter than that is one."""

    def cut(chars: Column) -> Column:
        runs = _runs_up_to(chars, most, "")
        return F.when(F.size(chars) < least, F.array(F.array_join(chars, ""))).otherwise(F.concat(*runs[least - 1 :]))

    return F.flatten(F.transform(F.transform(padded, lambda w: F.split(w, "")), cut))


#: Kinds of terms: how a text is cut, and what is made of the pieces.
WORD_TERMS, CHAR_TERMS = (word_tokens, word_grams), (padded_words, char_grams)


def tf_idf(items: DataFrame, train: Column, max_features: int = 5000, min_df: int = 2, key: str = "item_id", text: str = "text", terms=WORD_TERMS) -> DataFrame:
    """[key, term, weight]: the vocabulary is the max_features most frequent terms (words, or characters for Chinese) of the
    items where train holds, with document frequency min_df or more; (1 + ln tf)(ln((1 + n) / (1 + df)) + 1), rows of unit length.

    Texts are cut once, into a column that the grams are made of in time linear in the text; term counts are written once
    for vocabulary and weights.
    """
    cut, grams = terms
    pieces = items.select(key, F.coalesce(train, F.lit(False)).alias("_train"), cut(F.col(text)).alias("_pieces"))
    tf = written(pieces.select(key, "_train", F.explode(grams(F.col("_pieces"))).alias("term")).groupBy(key, "_train", "term").agg(F.count("*").alias("tf")))
    n = items.filter(train).count()
    vocab = tf.filter("_train").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
    w = (1 + F.ln("tf")) * (F.ln((1 + n) / (1 + F.col("df"))) + 1)
    raw = tf.join(F.broadcast(vocab), "term").select(key, "term", w.alias("w"))  # max_features rows
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # max_features rows a key at most
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def vector_means(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """[key, pos, mean]: element-wise means by partial sums; never all vectors of a key at once."""
    return vectors.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"))


def diagnostics(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """[zero_rows, mean_norm, mean_sd]: vectors of only zeros, mean length, mean over dimensions of the SD."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.agg(F.count_if(norm == 0).alias("zero_rows"), F.avg(norm).alias("mean_norm"))
    dims = vectors.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.stddev_pop("x").alias("sd")).agg(F.avg("sd").alias("mean_sd"))
    return rows.join(dims, how="cross")  # one row each


def skip_gram_noise(tokens: DataFrame, window: int = 2) -> DataFrame:
    """[centre, context, n, noise] of [walk, step, node]: pairs up to window apart in both directions, and the context's
    share of the counts to the power 3/4."""
    w = Window.partitionBy("walk").orderBy("step")
    near = [F.lag("node", i).over(w) for i in range(1, window + 1)] + [F.lead("node", i).over(w) for i in range(1, window + 1)]
    beside = tokens.select(F.col("node").alias("centre"), F.array(*near).alias("near"))
    pairs = beside.select("centre", F.explode(F.array_compact("near")).alias("context")).groupBy("centre", "context").agg(F.count("*").alias("n"))
    raised = tokens.groupBy(F.col("node").alias("context")).agg(F.pow(F.count("*"), F.lit(0.75)).alias("r"))
    total = raised.agg(F.sum("r").alias("all"))
    return pairs.join(raised, "context").join(F.broadcast(total), how="cross").select("centre", "context", "n", (F.col("r") / F.col("all")).alias("noise"))  # one row
