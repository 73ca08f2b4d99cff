"""Event series of accounts: gaps, histograms, entropy spectra, burstiness, memory, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import hour_of_day, ratio
from weftline.functions.segments import HOT_ROWS, hot_keys, quantiles, stepped

ORDERS = {"H_0": 0.0, "H_0.5": 0.5, "H_1": 1.0, "H_2": 2.0, "H_4": 4.0, "H_inf": float("inf")}


def gaps(posts: DataFrame) -> DataFrame:
    """[account_id, ts_ms, post_id, dt, next_dt]: time since the account's previous post and till its next one; zero gaps stay."""
    x = stepped(posts.select("account_id", "ts_ms", "post_id"), ["account_id"], ["ts_ms", "post_id"], {"_before": "ts_ms"}, {"_after": "ts_ms"})
    return x.select("account_id", "ts_ms", "post_id", (F.col("ts_ms") - F.col("_before")).alias("dt"), (F.col("_after") - F.col("ts_ms")).alias("next_dt")).filter("dt IS NOT NULL")


def bursts(gap: DataFrame) -> DataFrame:
    """[account_id, n_gaps, burstiness, cv, memory] on gaps in hours; 0 with under 2 (memory: 3) gaps or no variance."""
    x = gap.select("account_id", (F.col("dt") / 3_600_000).alias("a"), (F.col("next_dt") / 3_600_000).alias("b"))
    led = F.when(F.col("b").isNotNull(), F.col("a"))
    out = x.groupBy("account_id").agg(F.count("*").alias("n_gaps"), F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.stddev_pop(led).alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("cov"))
    many = F.col("n_gaps") >= 2
    return out.select(
        "account_id",
        "n_gaps",
        F.when(many, ratio(F.col("s") - F.col("m"), F.col("s") + F.col("m"))).otherwise(0.0).alias("burstiness"),
        F.when(many, ratio(F.col("s"), F.col("m"))).otherwise(0.0).alias("cv"),
        F.when(F.col("n_gaps") >= 3, ratio(F.col("cov"), F.col("sa") * F.col("sb"))).otherwise(0.0).alias("memory"),
    )


def log_bins(values: DataFrame, key: str, n_bins: int = 24, lo: float = 1.0, hi: float = 400 * 86_400_000.0, col: str = "dt") -> DataFrame:
    """[key, bin, n]: bin 0 holds values of 0 or less; then n_bins equal steps of the logarithm on [lo, hi], the last closed;
    values outside are dropped."""
    x = F.col(col).cast("double")
    edges = [lo * (hi / lo) ** (i / n_bins) for i in range(n_bins)]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= x))
    b = F.when(x <= 0, 0).when((x >= lo) & (x <= hi), at)
    return values.select(key, b.alias("bin")).filter("bin IS NOT NULL").groupBy(key, "bin").agg(F.count("*").alias("n"))


def hours(posts: DataFrame, key: str = "account_id") -> DataFrame:
    """[key, bin, n]: posts by hour of day, UTC."""
    return posts.groupBy(key, hour_of_day(F.col("ts_ms")).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def entropy_bits(alpha: float, c: Column) -> Column:
    """Order-alpha entropy in bits of grouped counts c, as one aggregate expression; near 1 the series about Shannon's."""
    total = F.sum(c).cast("double")
    if alpha == 0:
        nats = F.ln(F.sum(F.when(c > 0, 1).otherwise(0)).cast("double"))
    elif alpha == float("inf"):
        nats = F.ln(total) - F.ln(F.max(c).cast("double"))
    elif abs(alpha - 1) < 1e-6:
        e1 = F.sum(c * F.ln(c)) / total
        spread = F.sum(c * F.ln(c) * F.ln(c)) / total - e1 * e1
        nats = F.ln(total) - e1 - (alpha - 1) * spread / 2
    else:
        nats = (F.ln(F.sum(F.pow(c.cast("double"), F.lit(alpha)))) - alpha * F.ln(total)) / (1 - alpha)
    return nats / F.ln(F.lit(2.0))


def spectrum(counts: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """[key, H_0 .. H_inf] of the counts [key, bin, n], from power sums in one aggregate."""
    return counts.filter("n > 0").groupBy(key).agg(*[entropy_bits(a, F.col("n")).alias((prefix + name).replace(".", "_")) for name, a in ORDERS.items()])


def temporal_blocks(posts: DataFrame, min_events: int = 5, n_bins: int = 24) -> DataFrame:
    """One row an account of at least max(min_events, 2) posts: count, burst, Shannon and spectrum blocks.

    The spectrum of gaps is 0 for an account whose gaps all lie outside the bins.
    """
    size = posts.groupBy("account_id").agg(F.count("*").alias("n")).filter(F.col("n") >= max(min_events, 2))
    kept = posts.join(size.select("account_id"), "account_id", "left_semi")
    gap = gaps(kept)
    parts = [bursts(gap).drop("n_gaps"), spectrum(log_bins(gap, "account_id", n_bins), "account_id", "gap_"), spectrum(hours(kept), "account_id", "hour_")]
    out = size.select("account_id", F.log1p("n").alias("count"))
    for p in parts:
        out = out.join(p, "account_id", "left")
    return out.na.fill(0.0)


def kept_counts(posts: DataFrame, accounts: DataFrame, min_events: int = 5) -> DataFrame:
    """[label, kept, excluded]: accounts of at least max(min_events, 2) posts and the others, those without posts too."""
    n = posts.groupBy("account_id").agg(F.count("*").alias("n"))
    enough = F.coalesce(F.col("n") >= max(min_events, 2), F.lit(False))
    return accounts.select("account_id", "label").join(n, "account_id", "left").groupBy("label").agg(F.count_if(enough).alias("kept"), F.count_if(~enough).alias("excluded"))


def age_violations(posts: DataFrame, accounts: DataFrame, tolerance_ms: int = 0) -> DataFrame:
    """One row: events checked, violations, their share, accounts with any, accounts with events, worst backdate in days."""
    x = posts.join(accounts.select("account_id", "created_ms"), "account_id", "left")
    bad = F.col("ts_ms") < F.col("created_ms") - tolerance_ms
    one = x.groupBy("account_id").agg(F.sum(F.when(F.col("created_ms").isNotNull(), 1).otherwise(0)).alias("c"), F.sum(F.when(bad, 1).otherwise(0)).alias("v"), F.max(F.when(bad, F.col("created_ms") - F.col("ts_ms"))).alias("worst"))
    return one.agg(
        F.sum("c").alias("checked"), F.sum("v").alias("violations"), ratio(F.sum("v"), F.sum("c")).alias("fraction"),
        F.count_if(F.col("v") > 0).alias("accounts_with_any"), F.count("*").alias("accounts_with_events"),
        (F.max("worst") / 86_400_000).alias("worst_days"), F.max("v").alias("max_per_account"),
    )


def retention(posts: DataFrame, accounts: DataFrame, thresholds: list[int]) -> DataFrame:
    """[min_events, label, kept, share] for each label and over all (label null)."""
    size = accounts.select("account_id", "label").join(posts.groupBy("account_id").agg(F.count("*").alias("n")), "account_id", "left")
    sweep = size.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("min_events"))
    hit = F.when(F.col("n") >= F.col("min_events"), 1).otherwise(0)
    return sweep.rollup("min_events", "label").agg(F.sum(hit).alias("kept"), F.avg(hit).alias("share")).filter("min_events IS NOT NULL")


def counter_null(posts: DataFrame) -> DataFrame:
    """[post_id, null_ts]: ranks in time order rescaled to the range of times; what a bare counter would show."""
    from weftline.functions.lineage import ordered_index

    span = posts.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"), F.count("*").alias("n"))
    x = ordered_index(posts.select("post_id", "ts_ms"), F.col("ts_ms"), F.col("post_id")).join(F.broadcast(span), how="cross")  # one row
    spread = F.col("lo") + F.floor(F.col("idx") * (F.col("hi") - F.col("lo")) / (F.col("n") - 1))
    return x.select("post_id", F.when(F.col("n") < 2, F.col("ts_ms")).otherwise(spread).alias("null_ts"))


def hour_profile(posts: DataFrame) -> DataFrame:
    """One row: total variation from uniform over 24 hours and the peak to trough ratio (null with an empty hour)."""
    spine = posts.sparkSession.range(24).select(F.col("id").cast("int").alias("bin"))
    h = spine.join(hours(posts.withColumn("one", F.lit(1)), "one").select("bin", "n"), "bin", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    total = h.agg(F.sum("n").alias("all"))
    p = h.join(F.broadcast(total), how="cross")  # 24 rows by one
    return p.agg((0.5 * F.sum(F.abs(F.col("n") / F.col("all") - 1 / 24))).alias("tv"), F.try_divide(F.max("n").cast("double"), F.min("n")).alias("peak_trough"))


def cascade_times(nodes: DataFrame) -> DataFrame:
    """[item_id, log_span, log_median, rate, log_p90, first_hour] of [item_id, delay_min]; zeros with under two finite times.

    The rate is of all nodes, those without a time too, by the hours of the span.
    """
    finite = F.when(~F.isnan("delay_min") & (F.abs("delay_min") != float("inf")), F.col("delay_min"))
    span = F.max("t") - F.min("t")
    log = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
    timed = nodes.select("item_id", finite.alias("t"))
    parts = {"log_span": log(span), "rate": F.count("*") / (span / 60 + 1), "first_hour": F.count_if(F.col("t") <= 60) / F.nullif(F.count("t"), F.lit(0))}
    shares = {"mid": 0.5, "p90": 0.9}
    hot = hot_keys(timed, ["item_id"], HOT_ROWS)  # without one the quantiles are part of the same aggregate
    own = [F.percentile("t", q).alias(name) for name, q in shares.items()] if hot is None else []
    x = timed.groupBy("item_id").agg(F.count("t").alias("timed"), *[v.alias(k) for k, v in parts.items()], *own)
    x = x if hot is None else x.join(quantiles(timed, ["item_id"], "t", shares), "item_id")
    made = {"log_span": "log_span", "log_median": log(F.col("mid")), "rate": "rate", "log_p90": log(F.col("p90")), "first_hour": "first_hour"}
    x = x.withColumns({k: v for k, v in made.items() if not isinstance(v, str)})
    return x.select("item_id", *[F.when(F.col("timed") >= 2, F.col(k)).otherwise(0.0).alias(k) for k in made])


def log_bins_own(values: DataFrame, key: str, n_bins: int = 24, lo: float = 1.0, col: str = "dt") -> DataFrame:
    """log_bins with each key's own upper end: its largest value, ten times lo at least."""
    hi = values.groupBy(key).agg(F.greatest(F.max(col).cast("double"), F.lit(10 * lo)).alias("_hi"))
    x = F.col(col).cast("double")
    edges = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: lo * F.pow(F.col("_hi") / lo, i / n_bins))
    at = F.when(x <= 0, 0).when((x >= lo) & (x <= F.col("_hi")), F.size(F.filter(edges, lambda e: e <= x)))
    return values.join(hi, key).select(key, at.alias("bin")).filter("bin IS NOT NULL").groupBy(key, "bin").agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame, key: str) -> DataFrame:
    """[key, bin, p] of counts [key, bin, n]: shares without the empty bins."""
    full = counts.filter("n > 0")
    total = full.groupBy(key).agg(F.sum("n").alias("all"))
    return full.join(total, key).select(key, "bin", (F.col("n") / F.col("all")).alias("p"))


def gap_pairs(gap: DataFrame) -> DataFrame:
    """[account_id, post_id, a, b]: each gap and the account's next one."""
    return gap.select("account_id", "post_id", F.col("dt").alias("a"), F.col("next_dt").alias("b")).filter("b IS NOT NULL")


def gate(posts: DataFrame, accounts: DataFrame, t_min: int = 0, t_max: int = 4_102_444_800_000, most_early: float = 0.001, min_events: int = 32, least_kept: float = 0.8) -> DataFrame:
    """[range_ok, order_ok, ages_ok, retention_ok, passes], one row: whether a set of posts is fit for the analysis.

    All posts lie in the range, both ends included; no gap is negative; under most_early of them lie before their account;
    and of each label's accounts least_kept or more have min_events posts.
    """
    span = posts.agg(((F.min("ts_ms") >= t_min) & (F.max("ts_ms") <= t_max)).alias("range_ok"))
    order = gaps(posts).agg(F.coalesce(F.min("dt") >= 0, F.lit(True)).alias("order_ok"))
    ages = age_violations(posts, accounts).select((F.col("fraction") < most_early).alias("ages_ok"))
    kept = kept_counts(posts, accounts, min_events).agg((F.min(F.col("kept") / (F.col("kept") + F.col("excluded"))) >= least_kept).alias("retention_ok"))
    out = span.join(order, how="cross").join(ages, how="cross").join(kept, how="cross")  # one row each
    return out.withColumn("passes", F.col("range_ok") & F.col("order_ok") & F.col("ages_ok") & F.col("retention_ok"))
