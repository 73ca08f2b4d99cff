"""Language identification by compression with per-language raw-content zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from weftline.llm.common import BOX, boxed, crc_bucket, each_text, small_batches, table, text_or_empty, unboxed

#: The bounded sample of labelled rows that fits the dictionaries: about ROWS rows a language, SNIPPETS pieces of
#: SNIPPET_CHARS characters spread over the whole of each, and DICT_BYTES of them a dictionary.
ROWS, SNIPPETS, SNIPPET_CHARS, DICT_BYTES = 384, 8, 256, 131_072
LEVEL, BLOCK_BYTES = 3, 1_024
#: Below this relative margin between the smallest and the next size the document is rejected.
MIN_MARGIN = 0.002


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 7) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the language with the most different texts first.

    Rows with a null text or language are left out, and a text's copies count once. The sample is the texts whose hash
    lies below a threshold set from each language's count of different texts, so it doesn't grow with the table; the
    bound on its pieces holds for each language by itself.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit(seed)).alias("h"))
    counts = sorted(((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.countDistinct("h").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, ROWS / n)))])
    drawn = rows.filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).dropDuplicates(["lang", "h"])
    step = F.greatest(F.lit(SNIPPET_CHARS), F.floor(F.length("text") / SNIPPETS))
    starts = F.sequence(F.lit(0), F.least(F.lit(SNIPPETS - 1), F.floor(F.length("text") / step)))
    pieces = drawn.select("lang", "h", F.explode(F.transform(starts, lambda i: F.substr("text", (i * step + 1).cast("int"), F.lit(SNIPPET_CHARS)))).alias("piece"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("piece", "h"), "piece"))
    held: dict[str, list[tuple[int, str]]] = {lang: [] for lang, _ in counts}
    for r in pieces.withColumn("at", order).filter(F.col("at") <= 2 * ROWS * SNIPPETS).select("lang", "at", "piece").collect():
        held[r["lang"]].append((r["at"], r["piece"].lower()))
    return [(lang, "".join(p for _, p in sorted(v)).encode()[:DICT_BYTES]) for lang, v in held.items() if v]


def _compressors(dictionaries: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def sizes_of(text: str, compressors: list) -> list[int]:
    """Compressed bytes of the whole text under each dictionary, in blocks so that all of it leans on the dictionary."""
    data = text.lower().encode("utf-8", "surrogatepass")
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns + lang_pred STRING, lang_score DOUBLE (0 to 1), lang_rejected BOOLEAN.

    The language with the smallest size wins; on equal sizes the one more frequent in training. The score is the best
    size's share of lead: with sizes b <= s of the best two, b's weight under a Gibbs distribution over sizes relative
    to the text. Rejected: a margin (s - b) / s under min_margin. A text that is null or has no letter is `und` with
    score 0 and rejected; without dictionaries every text is. Very long texts are read whole, in blocks. Rows are
    independent, so ties and repeated rows change nothing; input columns named like an output are replaced, other names
    never clash; an empty table gives an empty result. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages * DICT_BYTES
    rows = small_batches(docs).select(boxed(docs), text_or_empty(text_col).alias("_text"))
    schema = StructType([rows.schema[BOX], StructField("pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = [x for x, _ in shared.value]
        compressors = _compressors(shared.value)
        for batch in batches:
            pred, score, rejected = [], [], []
            for text in map(bytes.decode, each_text(batch, "_text")):
                if not compressors or not any(map(str.isalpha, text)):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                s = sizes_of(text, compressors)
                best = min(range(len(s)), key=s.__getitem__)
                rel = (np.array(s) - s[best]) / s[best]
                ranked = sorted(s)
                margin = (ranked[1] - ranked[0]) / ranked[1] if len(s) > 1 else 1.0
                pred.append(langs[best])
                score.append(float(1.0 / np.exp(-50.0 * rel).sum()))
                rejected.append(margin < min_margin)
            yield pa.RecordBatch.from_arrays([batch.column(BOX), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], schema.names)

    return unboxed(rows.mapInArrow(run, schema), docs, {"lang_pred": F.col("pred"), "lang_score": F.col("score"), "lang_rejected": F.col("rejected")})


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    model = fit(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
