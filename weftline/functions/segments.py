"""Work within keys of which one may hold a third of all rows: neighbours, numbers, order statistics, quotas.

Keys of few rows take Spark's own windows and aggregates. Hot keys, those of more rows than a stated limit, are told by
one aggregate; there are at most rows / limit of them, so tables by hot key are small and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import written

#: Rows of a key beyond which it is spread over tasks, and rows of a bracket that one task sorts.
HOT_ROWS, BRACKET_ROWS, BINS = 1_000_000, 100_000, 1_024


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def _by_hot(df: DataFrame, hot: DataFrame, keys: list[str], how: str) -> DataFrame:
    return df.alias("l").join(F.broadcast(hot.alias("r")), _same(keys), how)  # rows / limit keys


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """[keys] of more than limit rows, or None without any; a table of no more rows has none."""
    if df.count() <= limit:
        return None
    hot = written(df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys))
    return None if hot.isEmpty() else hot


def stepped(df: DataFrame, keys: list[str], order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None, number: str | None = None, first: dict[str, str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df + for each name in before (after, first) the column's value in the key's previous (next, first) row, and the row's place in its key from 0.

    order must tell the rows of a key apart. Rows of hot keys are cut by range of key and order: neighbours are looked up in
    the range, and a range's first and last row take what the ranges beside it carry over; places get the counts of the
    key in the ranges before. A range belongs to one key only in part, so the carried table has one row a range.
    """
    before, after, first = before or {}, after or {}, first or {}
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = {**{k: F.lag(c).over(w) for k, c in before.items()}, **{k: F.lead(c).over(w) for k, c in after.items()}}
    plain |= {k: F.first(c).over(w) for k, c in first.items()}
    if number:
        plain[number] = (F.row_number().over(w) - 1).cast("long")
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumns(plain)
    cold = _by_hot(df, hot, keys, "left_anti").withColumns(plain)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(_by_hot(df, hot, keys, "left_semi").repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p", *keys).orderBy(*order)  # one range's rows
    spot, key = F.struct(*keys, *order), F.struct(*keys)
    held = F.struct(*[F.col(c) for c in {*keys, *before.values(), *after.values()}])
    edges = parts.groupBy("_p").agg(F.min_by(held, spot).alias("first"), F.max_by(held, spot).alias("last"), F.min_by(key, spot).alias("first_key"), F.max_by(key, spot).alias("last_key"))
    along = Window.orderBy("_p")  # one row a range
    counts = parts.groupBy("_p", *keys).agg(F.count("*").alias("_n"))  # hot keys and ranges
    runs = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", key.alias("first_key"), "_before")
    carried = edges.select("_p", "first_key", F.lag("last").over(along).alias("_prev"), F.lag("last_key").over(along).alias("_prev_key"), F.lead("first").over(along).alias("_next"), F.lead("first_key").over(along).alias("_next_key"))
    carried = carried.join(runs, ["_p", "first_key"]).select("_p", F.col("first_key").alias("_first_key"), "_prev", "_prev_key", "_next", "_next_key", "_before")
    x = parts.join(F.broadcast(carried), "_p").withColumns({"_at": F.row_number().over(own), "_left": F.count("*").over(Window.partitionBy("_p", *keys))})
    from_prev, from_next = (F.col("_at") == 1) & F.col("_prev_key").eqNullSafe(key), (F.col("_at") == F.col("_left")) & F.col("_next_key").eqNullSafe(key)
    out = {k: F.when(from_prev, F.col(f"_prev.{c}")).otherwise(F.lag(c).over(own)) for k, c in before.items()}
    out |= {k: F.when(from_next, F.col(f"_next.{c}")).otherwise(F.lead(c).over(own)) for k, c in after.items()}
    if first:
        heads = parts.groupBy(*keys).agg(*[F.min_by(c, F.struct(*order)).alias(f"_f_{k}") for k, c in first.items()])
        x = x.alias("l").join(F.broadcast(heads.alias("r")), _same(keys)).select("l.*", *[f"r._f_{k}" for k in first])  # hot keys
        out |= {k: F.col(f"_f_{k}") for k in first}
    if number:
        out[number] = (F.col("_at") - 1 + F.when(F.col("_first_key").eqNullSafe(key), F.col("_before")).otherwise(0)).cast("long")
    return cold.unionByName(x.withColumns(out).select(cold.columns))


def order_statistics(rows: DataFrame, keys: list[str], value: str, targets: DataFrame, bins: int = BINS, bracket: int = BRACKET_ROWS) -> DataFrame:
    """[keys, rank, v, below]: for each target [keys, rank] (from 0) the key's value of that rank, and how many values are smaller.

    Each target has a bracket of values and the count of those below. A round counts the bracket's values in equal steps and
    goes on with the step that the rank falls in, between its own least and greatest value, so every round parts unequal
    values. A bracket of few rows is sorted. Values must be finite and not null; targets are few and are broadcast.
    """
    rows = written(rows.select(*keys, F.col(value).cast("double").alias("v")))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("inside"))
    state = written(targets.select(*keys, "rank").alias("l").join(ends.alias("r"), _same(keys)).select(*[F.col(f"l.{k}") for k in keys], "rank", "lo", "hi", "inside", F.lit(0).cast("long").alias("below")).filter("rank BETWEEN 0 AND inside - 1"))
    wide = (F.col("inside") > bracket) & (F.col("lo") < F.col("hi"))

    def within(some: DataFrame) -> DataFrame:
        met = rows.alias("l").join(F.broadcast(some.alias("r")), _same(keys) & F.col("v").between(F.col("lo"), F.col("hi")))
        return met.select(*[F.col(f"r.{k}") for k in keys], "rank", "lo", "hi", "below", "v")

    while not (live := state.filter(wide)).isEmpty():
        step = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        by = within(live).groupBy(*keys, "rank", "below", step.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        up_to = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # bins rows
        at = by.withColumn("below", F.col("below") + up_to - F.col("n")).filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        state = written(state.filter(~wide).unionByName(at.select(*keys, "rank", "lo", "hi", F.col("n").alias("inside"), "below")))
    last = within(state).groupBy(*keys, "rank", "below", "v").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("v"))  # bracket rows at most
    found = last.withColumn("below", F.col("below") + up_to - F.col("n")).filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
    return found.select(*keys, "rank", "v", "below")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], hot_rows: int = HOT_ROWS, bins: int = BINS, bracket: int = BRACKET_ROWS) -> DataFrame:
    """[keys, a column a share]: exact quantiles of the key's values that are not null, linear between neighbours; without keys one row.

    A key without values has nulls. Values must be finite.
    """
    if not keys:
        one = quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, shares, hot_rows, bins, bracket)
        none = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
        return none.join(one, "_all", "left").drop("_all")
    x = df.select(*keys, F.col(value).cast("double").alias("v"))
    plain = [F.percentile("v", q).alias(name) for name, q in shares.items()]
    hot = hot_keys(x.filter("v IS NOT NULL"), keys, hot_rows)
    if hot is None:
        return x.groupBy(*keys).agg(*plain)
    cold = _by_hot(x, hot, keys, "left_anti").groupBy(*keys).agg(*plain)
    warm = written(_by_hot(x.filter("v IS NOT NULL"), hot, keys, "left_semi"))
    place = {name: (F.col("n") - 1) * F.lit(q) for name, q in shares.items()}
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place.values()])))).alias("rank")
    sizes = written(warm.groupBy(*keys).agg(F.count("*").alias("n")))
    found = written(order_statistics(warm, keys, "v", sizes.select(*keys, wanted), bins, bracket))
    out = sizes.alias("l").join(found.alias("r"), _same(keys)).select(*[F.col(f"l.{k}") for k in keys], "n", "rank", "v")
    share = lambda p: F.sum(F.col("v") * (F.when(F.col("rank") == F.floor(p), 1 - (p - F.floor(p))).otherwise(0) + F.when((F.col("rank") == F.ceil(p)) & (F.ceil(p) > F.floor(p)), p - F.floor(p)).otherwise(0)))
    return cold.unionByName(out.groupBy(*keys).agg(*[share(p).alias(name) for name, p in place.items()]))


def within_quotas(df: DataFrame, keys: list[str], drawn: Column, tie: str, quotas: dict[str, Callable[[Column], Column]], hot_rows: int = HOT_ROWS, bins: int = BINS, bracket: int = BRACKET_ROWS) -> DataFrame:
    """df + a BOOLEAN a name: whether the row is among its key's quota of lowest (drawn, tie); a quota is made from the key's row count.

    No row of a hot key is sorted: histograms of the draws are refined to the quota's draw, and only rows that share it are
    ordered by tie.
    """
    named = df.withColumn("_draw", drawn)
    hot = hot_keys(named, keys, hot_rows)

    def ranked(x: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        sized = x.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy("_draw", tie))})
        return sized.withColumns({f"_in_{name}": F.col("_r") <= q(F.col("_n")) for name, q in quotas.items()}).select(*df.columns, *[F.col(f"_in_{name}").alias(name) for name in quotas])

    if hot is None:
        return ranked(named)
    warm = written(_by_hot(named, hot, keys, "left_semi"))
    sizes = warm.groupBy(*keys).agg(F.count("*").alias("_n"))
    asked = written(sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), q(F.col("_n")).cast("long").alias("quota")) for name, q in quotas.items()])).alias("q")).select(*keys, "q.*"))
    at = order_statistics(warm, keys, "_draw", asked.filter("quota > 0").select(*keys, (F.col("quota") - 1).alias("rank")).distinct(), bins, bracket)
    cut = written(asked.alias("l").join(at.alias("r"), _same(keys) & (F.col("r.rank") == F.col("l.quota") - 1)).select(*[F.col(f"l.{k}") for k in keys], "name", "quota", "v", "below"))
    # df's own columns may have the cut's names
    tied = warm.alias("l").join(F.broadcast(cut.alias("r")), _same(keys) & (F.col("l._draw") == F.col("r.v"))).select(*[F.col(f"r.{c}") for c in [*keys, "name", "v", "below", "quota"]], F.col(f"l.{tie}").alias("t"))
    last = tied.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("t"))).filter("k = quota - below")  # rows of one draw
    bounds = last.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.struct("v", "t"))).alias(f"_b_{name}") for name in quotas])
    met = warm.alias("l").join(F.broadcast(bounds.alias("r")), _same(keys), "left").select("l.*", *[f"r._b_{name}" for name in quotas])
    ok = lambda b: F.coalesce((F.col("_draw") < F.col(f"{b}.v")) | ((F.col("_draw") == F.col(f"{b}.v")) & (F.col(tie) <= F.col(f"{b}.t"))), F.lit(False))
    return ranked(_by_hot(named, hot, keys, "left_anti")).unionByName(met.select(*df.columns, *[ok(f"_b_{name}").alias(name) for name in quotas]))
