"""Hot keys give what Spark's own windows and aggregates give; one key holds a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import segments
from weftline.functions.scalars import draw


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(500), i, rng.choice([rng.gauss(0, 1), 10.0 ** rng.randrange(-12, 12), 7.0])) for i in range(6_000)]
    return spark.createDataFrame(made, "key string, ts long, id long, x double").repartition(5).cache()


@pytest.mark.parametrize("limit", [100, 1_000, 10**6])
def test_stepped(rows, limit):
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = rows.withColumns({"a": F.lag("ts").over(w), "b": F.lead("x").over(w), "n": F.row_number().over(w) - 1})
    want = want.withColumn("f", F.first("id").over(w))
    got = segments.stepped(rows, ["key"], ["ts", "id"], {"a": "ts"}, {"b": "x"}, "n", {"f": "id"}, hot_rows=limit)
    cols = ["id", "a", "b", "n", "f"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_hot_ranges_are_spread(rows):
    plan = segments.stepped(rows, ["key"], ["ts", "id"], number="n", hot_rows=100).filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(plan) > 3 and max(r["count"] for r in plan) < 1_500


@pytest.mark.parametrize("bins,bracket", [(2, 1), (16, 10), (1_024, 100_000)])
def test_order_statistics(spark, rows, bins, bracket):
    x = rows.filter("key IS NOT NULL")
    held = {}
    for r in x.collect():
        held.setdefault(r["key"], []).append(r["x"])
    want = {(k, i) for k, v in held.items() for i in (0, 1, len(v) // 2, len(v) - 1, len(v)) if i <= len(v)}
    got = segments.order_statistics(x, ["key"], "x", spark.createDataFrame(sorted(want), "key string, rank long"), bins, bracket).collect()
    assert len(got) == sum(i < len(held[k]) for k, i in want)
    for r in got:
        v = sorted(held[r["key"]])
        assert r["v"] == v[r["rank"]] and r["below"] == sum(y < r["v"] for y in v)


@pytest.mark.parametrize("limit", [50, 10**6])
def test_quantiles_are_numpys(rows, limit):
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "top": 1.0}
    held = {}
    for r in rows.collect():
        held.setdefault(r["key"], []).append(r["x"])
    for r in segments.quantiles(rows, ["key"], "x", shares, limit, 8, 20).collect():
        for name, q in shares.items():
            assert r[name] == pytest.approx(np.quantile(held[r["key"]], q), rel=1e-12, abs=1e-12)
    one = segments.quantiles(rows, [], "x", shares, limit, 8, 20).first()
    every = [y for v in held.values() for y in v]
    assert all(one[name] == pytest.approx(np.quantile(every, q), rel=1e-12) for name, q in shares.items())
    assert segments.quantiles(rows.limit(0), [], "x", shares).collect() == [(None,) * 5]


@pytest.mark.parametrize("limit", [100, 10**6])
def test_within_quotas(rows, limit):
    coarse = F.floor(draw("id", seed=3) * 200) / 200  # many ties
    quotas = {"test": lambda n: F.bround(n * 0.2), "more": lambda n: F.bround(n * 0.5), "none": lambda n: F.lit(0), "all": lambda n: n}
    w = Window.partitionBy("key")
    want = rows.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(coarse, "id"))}).select("id", *[(F.col("r") <= q(F.col("n"))).alias(k) for k, q in quotas.items()])
    got = segments.within_quotas(rows, ["key"], coarse, "id", quotas, limit, 8, 20)
    assert sorted(got.select("id", *quotas).collect()) == sorted(want.collect())


@pytest.mark.parametrize("limit", [50, 10**6])
def test_quotas_of_columns_that_are_named_as_the_cut_is(spark, limit):
    """Hot windows of edges [w, u, v], as augment() has them: v, and the other names of the cut, are the rows' own, too."""
    x = spark.range(300).select((F.col("id") % 2).alias("w"), (F.col("id") % 7).alias("u"), "id", *[(F.col("id") * 3).alias(c) for c in ("v", "below", "quota", "name")])
    rows = x.withColumn("e", F.struct("u", "v"))
    coarse = F.floor(draw("w", "id", seed=3) * 20) / 20
    w = Window.partitionBy("w")
    want = rows.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(coarse, "e"))}).select("w", "u", "v", (F.col("r") <= F.bround(F.col("n") * 0.3)).alias("gone"))
    got = segments.within_quotas(rows, ["w"], coarse, "e", {"gone": lambda m: F.bround(m * 0.3)}, limit, 8, 20)
    assert sorted(got.select("w", "u", "v", "gone").collect()) == sorted(want.collect())
