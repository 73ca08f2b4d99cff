"""Registering a query together with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.canonical import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, columns: str, tables: str = "", sql: str | None = None) -> Callable:
    """Registers f(spark, sf_dir). columns: `name:kind` each, with i for whole numbers, f for numbers compared to six
    decimals, s for text, b for booleans; both sides are cast by them. tables: canonical tables that sql uses."""
    spec = [c.split(":") for c in columns.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            cast = {"i": lambda c: F.col(c).cast("long"), "f": lambda c: F.round(F.col(c).cast("double"), 6) + 0.0, "s": lambda c: F.col(c).cast("string"), "b": lambda c: F.col(c).cast("boolean")}
            return f(spark, sf_dir).select(*[cast[k](c).alias(c) for c, k in spec])

        QUERIES[name] = run
        if sql:
            cast = {"i": "{0}::BIGINT", "f": "round({0}::DOUBLE, 6) + 0.0", "s": "{0}::VARCHAR", "b": "{0}::BOOLEAN"}
            cols = ", ".join(f"{cast[k].format(c)} AS {c}" for c, k in spec)
            ORACLES[name] = f"SELECT {cols} FROM ({with_tables(sql, *tables.split())})"
        return f

    return register
