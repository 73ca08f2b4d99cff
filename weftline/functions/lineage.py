"""Cutting lineage in loops, and dense numbering without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's shared spark.checkpoint.dir. Without one a local session gets a local folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, n: Column, name: str, rows: int = 10_000) -> DataFrame:
    """df's rows, each n times, with name from 0 to n - 1. They are made in stretches of so many that are dealt over tasks, as
    a table of few rows is one partition; a row without n or with none is left out."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.withColumn("_n", n.cast("long")).filter("_n > 0")
    starts = sized.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(rows).cast("long")))).repartition(parts)
    own = F.sequence(F.col("_from"), F.least(F.col("_from") + rows, F.col("_n")) - 1)
    return starts.withColumn(name, F.explode(own)).drop("_n", "_from")


def ordered_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """df + a gapless index from 0 in the given order: a range sort, a rank in each partition, and the partitions' offsets."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_r", rank).join(before, "_p").withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_p", "_r", "_before")


def running_before(df: DataFrame, values: dict[str, Column], *order: Column) -> DataFrame:
    """df + for each name the sum of its value over all rows before in the order: a range sort, sums in each partition, and offsets."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    parts = written(own.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.groupBy("_p").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values]).select("_p", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)) for k in values}).join(F.broadcast(starts), "_p")
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in values}).drop("_p", *[f"_{x}_{k}" for x in "vb" for k in values])
