"""Connected components by alternating star contraction, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import reliable


def connected_components(edges: DataFrame) -> DataFrame:
    """[node, root] for every node of the edges (a, b), any orderable type: root is the component's smallest node.

    Null ends and loops are left out; repeated edges count once. Each round is two star steps (aggregate the least
    neighbour, join it back), written to the checkpoint folder; rounds end when the edges stop changing. The least
    neighbour is pre-aggregated, so a node with very many links sends one row a task, and the join back has one row a
    node on its other side, so Spark can split a hot node's partition.
    """
    e = reliable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if sign == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
        seen = sign
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        e = reliable(
            large.join(down, large["a"] == down["n"])
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .filter("a <> b")
            .distinct()
        )
