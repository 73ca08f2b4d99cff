"""Writing results and caches, and reading them back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def cached(spark: SparkSession, folder: str, name: str, config: dict, build: Callable[[], DataFrame], key: str | None = None, buckets: int = 64) -> DataFrame:
    """The table as a Parquet cache, built if it isn't there; the path holds a hash of config, so other rules never meet an old cache.

    With a key it is partitioned by that key's hash bucket. A cache counts as there only when its write has ended.
    """
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{digest}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        df = build()
        if key is not None:
            df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("bucket")


def long_results(spark: SparkSession, results: list[dict]) -> DataFrame:
    """[run_id, variant, seed, metric, value] of result records {run_id, variant, seed, metrics: {..}}."""
    rows = [(r["run_id"], r.get("variant"), r.get("seed"), k, None if v is None else float(v)) for r in results for k, v in r["metrics"].items()]
    return spark.createDataFrame(rows, "run_id string, variant string, seed int, metric string, value double")


def save_results(results: DataFrame, path: str) -> DataFrame:
    """The table as JSON lines, and read back."""
    results.write.mode("overwrite").json(path)
    return results.sparkSession.read.schema(results.schema).json(path)


def table_csv(df: DataFrame, path: str) -> DataFrame:
    """The table as CSV with a header; one that is there already is read back instead."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    return spark.read.schema(df.schema).csv(path, header=True, escape='"')


def compact_vectors(vectors: DataFrame, labelled: DataFrame, key: str, path: str) -> DataFrame:
    """Vectors of labelled keys alone as Parquet, and read back; a semi join before the write keeps the rest unread."""
    vectors.join(labelled.select(key), key, "left_semi").write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


class Memo:
    """Tables kept by the fields that change their result; release() lets go of all."""

    def __init__(self) -> None:
        self._held: dict[tuple, DataFrame] = {}

    def get(self, build: Callable[[], DataFrame], **fields) -> DataFrame:
        key = tuple(sorted((k, repr(v)) for k, v in fields.items()))
        if key not in self._held:
            self._held[key] = build().persist()
        return self._held[key]

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()
