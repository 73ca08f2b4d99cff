"""New nodes scored from a stream, each micro-batch against the stored node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.passing import Matrix, inductive


def score_arrivals(arrivals: DataFrame, stored: DataFrame, stats: DataFrame, weights: Matrix, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes [node, x] of arriving [node, x, near ARRAY] rows to Parquet under path; stored nodes and statistics stay as they are.

    A batch is written to its own folder, overwritten if it is run again after a failure, so each arrival is there once.
    once takes what has arrived and stops.
    """

    def batch(rows: DataFrame, number: int) -> None:
        near = rows.select(F.explode("near").alias("src"), F.col("node").alias("dst"))
        inductive(rows.select("node", "x"), near, stored, stats, weights).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
