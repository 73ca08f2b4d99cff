"""Splits, exact ranking metrics, paired tests, scaling and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import ordered_index, running_before, written
from weftline.functions.scalars import draw, ratio
from weftline.functions.segments import stepped, within_quotas


def stratified(rows: DataFrame, id_col: str, label: str, test: float, val: float, seed: int) -> DataFrame:
    """rows + split: within each label the lowest draws are test, then val; quotas are rounded half to even."""
    t, v = lambda n: F.bround(n * test), lambda n: F.bround(n * val)
    named = within_quotas(rows, [label], draw(id_col, seed=seed), id_col, {"_test": t, "_more": lambda n: t(n) + v(n)})
    return named.withColumn("split", F.when(F.col("_test"), "test").when(F.col("_more"), "val").otherwise("train")).drop("_test", "_more")


def grouped_split(rows: DataFrame, group: str, test: float, val: float, seed: int) -> DataFrame:
    """rows + split by whole groups: of the groups in draw order max(1, round(n test)) are test, then max(1, round(n val)) val."""
    groups = written(rows.select(group).distinct())
    n = groups.count()
    if n < 3:
        raise ValueError("at least three groups are needed")
    t, v = (max(1, round(n * share)) for share in (test, val))
    r = F.col("idx")
    numbered = ordered_index(groups.withColumn("_draw", draw(group, seed=seed)), F.col("_draw"), F.col(group))
    named = numbered.select(group, F.when(r < t, "test").when(r < t + v, "val").otherwise("train").alias("split"))
    return rows.join(named, group)


def folds(rows: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    """rows + fold 0 to k - 1: rows of a label are dealt round in draw order."""
    placed = stepped(rows.withColumn("_draw", draw(id_col, seed=seed)), [label], ["_draw", id_col], number="_at")
    return placed.withColumn("fold", F.pmod("_at", F.lit(k)).cast("int")).drop("_draw", "_at")


def auc(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """[keys, auc]: exact area by the rank formula after grouping by score, ties counted half; null with one class."""
    keys = keys or []
    by = scores.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    below = running_before(by, {"below": F.col("n")}, *[F.col(k) for k in keys], F.col("score"))
    if keys:
        below = below.join(below.groupBy(*keys).agg(F.min("below").alias("_start")), keys).withColumn("below", F.col("below") - F.col("_start"))
    area = F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double"))
    return below.groupBy(*keys).agg(area.alias("auc")) if keys else below.agg(area.alias("auc"))


def binary(scores: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """[keys, tp, fp, fn, tn, precision, recall, f1, accuracy]; 0 on empty denominators."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    c = scores.groupBy(*(keys or [])).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def threshold_sweep(scores: DataFrame, steps: int = 91) -> DataFrame:
    """[t, f1, best]: F1 at 0.05 .. 0.95 and whether it is the first maximum."""
    # every score falls in the bin of the highest threshold it reaches; running sums of so many bins give the counts
    edges = F.array(*[F.lit(t / 100) for t in range(5, 5 + steps)])
    reached = F.size(F.filter(edges, lambda e: e <= F.col("score")))
    bins = scores.groupBy(reached.alias("bin"), "label").agg(F.count("*").alias("n"))
    t = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i")
    x = bins.select("bin", "label", "n", t)  # at most 2 * (steps + 1) rows, each for steps thresholds
    hit, pos = F.col("bin") >= F.col("i"), F.col("label") == 1
    c = x.groupBy((F.col("i") + 4).alias("t")).agg(*[F.sum(F.when(a, F.col("n")).otherwise(0)).alias(k) for k, a in (("tp", hit & pos), ("fp", hit & ~pos), ("fn", ~hit & pos))])
    f = c.select("t", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    first = f.agg(F.min_by("t", F.struct(-F.round("f1", 9), F.col("t"))).alias("b"))
    return f.join(F.broadcast(first), how="cross").select((F.col("t") / 100).alias("t"), "f1", (F.col("t") == F.col("b")).alias("best"))  # one row


def roc(scores: DataFrame) -> DataFrame:
    """[score, fpr, tpr, fpr_before, tpr_before] in falling score; one row a distinct score, and the point before it."""
    by = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    x = running_before(by, {"np": F.col("p"), "nn": F.col("n")}, F.desc("score")).join(F.broadcast(total), how="cross")  # one row
    return x.select("score", ratio(F.col("nn") + F.col("n"), F.col("all_n")).alias("fpr"), ratio(F.col("np") + F.col("p"), F.col("all_p")).alias("tpr"), ratio(F.col("nn"), F.col("all_n")).alias("fpr_before"), ratio(F.col("np"), F.col("all_p")).alias("tpr_before"))


def tpr_at(scores: DataFrame, fpr: float = 0.01) -> DataFrame:
    """[tpr]: linear interpolation on the ROC curve, from (0, 0)."""
    f0, t0 = F.col("fpr_before"), F.col("tpr_before")
    at = t0 + (F.col("tpr") - t0) * ratio(fpr - f0, F.col("fpr") - f0)
    return roc(scores).filter((F.col("fpr") > fpr) & (f0 <= fpr)).agg(F.max(at).alias("tpr"))


def signed_rank_p(ranks: list[float], up: float) -> float:
    """Two-sided p of a signed-rank sum: of all ways to sign the ranks the share whose smaller sum is no larger.

    Sums of ranks are counted rank by rank; ranks are multiples of one half, as ties share their mean.
    """
    twice = [round(2 * r) for r in ranks]
    ways = [1] + [0] * sum(twice)
    top = 0
    for r in twice:
        top += r
        for s in range(top, r - 1, -1):
            ways[s] += ways[s - r]
    low = min(round(2 * up), top - round(2 * up))
    return min(1.0, 2 * sum(ways[: low + 1]) / (1 << len(twice)))


#: Most differences whose signs are counted exactly; beyond, the normal approximation.
EXACT_PAIRS = 50


def paired(diffs: DataFrame, floor: float = 0.02, population: bool = False) -> DataFrame:
    """[n, mean, sd, wins, p, significant, clears]: signed-rank test of [d]; exact for up to EXACT_PAIRS nonzero differences,
    else the normal approximation; all zero gives p = 1. Zero differences are dropped from the test. clears: the mean lies
    above the floor and p below 0.05; population: the SD's kind."""
    sd = F.stddev_pop if population else F.stddev_samp
    base = diffs.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), sd("d").alias("sd"), F.count_if(F.col("d") > 0).alias("wins"))
    by = diffs.filter("d <> 0").groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = written(running_before(by, {"lower": F.col("k")}, F.col("a")).withColumn("rank", F.col("lower") + (F.col("k") + 1) / 2))
    s = ranked.agg(F.sum("k").alias("m"), F.sum(F.col("rank") * F.col("up")).alias("wp"), F.sum(F.col("rank") * F.col("k")).alias("all"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"))
    got = s.first()
    if not got["m"]:
        p = 1.0
    elif got["m"] <= EXACT_PAIRS:
        p = signed_rank_p([r["rank"] for r in ranked.select("rank", "k").collect() for _ in range(r["k"])], got["wp"])  # EXACT_PAIRS at most
    else:
        from math import erfc, sqrt

        m = got["m"]
        z = (min(got["wp"], got["all"] - got["wp"]) - got["all"] / 2) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - got["ties"] / 48)
        p = erfc(abs(z) / sqrt(2))
    return base.withColumns({"p": F.lit(p), "significant": F.lit(p < 0.05), "clears": (F.col("mean") > floor) & F.lit(p < 0.05)})


def multiclass(rows: DataFrame, y: str, predicted: str) -> DataFrame:
    """[n, accuracy, macro_f1, micro_f1, majority]: macro over the labels that are seen or predicted; majority is the largest label's share."""
    c = classification(rows, y, predicted)
    hits = rows.agg(F.count("*").alias("all"), F.count_if(F.col(y) == F.col(predicted)).alias("right"))
    by = c.agg(F.avg("f1").alias("macro_f1"), F.max("n").alias("top"))
    x = hits.join(by, how="cross")  # one row each
    return x.select(F.col("all").alias("n"), ratio(F.col("right"), F.col("all")).alias("accuracy"), "macro_f1", ratio(F.col("right"), F.col("all")).alias("micro_f1"), ratio(F.col("top"), F.col("all")).alias("majority"))


def one_vs_rest_auc(scores: DataFrame) -> DataFrame:
    """[auc]: the mean over labels of each label's area, from [label, class, score] rows; null if a class has no row of its own."""
    one = scores.select("class", (F.col("label") == F.col("class")).cast("int").alias("label"), "score")
    return auc(one, ["class"]).agg(F.when(F.count_if(F.col("auc").isNull()) == 0, F.avg("auc")).alias("auc"))


def confusion(rows: DataFrame, y: str, predicted: str) -> DataFrame:
    """[y, predicted, n, share]: all cells of the seen labels, zero ones too, and each cell's share of its row."""
    labels = rows.select(F.col(y).alias("l")).union(rows.select(predicted)).distinct()
    cells = labels.select(F.col("l").alias("y")).crossJoin(F.broadcast(labels.select(F.col("l").alias("predicted"))))  # labels squared
    n = rows.groupBy(F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    full = cells.join(n, ["y", "predicted"], "left").select("y", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y"))))


def classification(rows: DataFrame, y: str, predicted: str) -> DataFrame:
    """[label, n, precision, recall, f1] by label; averages are one aggregate away."""
    c = confusion(rows, y, predicted)
    tp = c.filter("y = predicted").select(F.col("y").alias("label"), F.col("n").alias("tp"))
    seen = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("n"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    x = tp.join(seen, "label").join(said, "label")
    return x.select("label", "n", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("n")).alias("recall"), ratio(2 * F.col("tp"), F.col("n") + F.col("said")).alias("f1"))


def min_max(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    s = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    x = rows.join(F.broadcast(s), how="cross")  # one row
    return x.withColumns({c: ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in cols}).select(rows.columns)


def z_score(rows: DataFrame, cols: list[str], population: bool = True) -> DataFrame:
    """Columns centred and divided by their population SD, or sample SD floored at 1e-6."""
    sd = F.stddev_pop if population else F.stddev_samp
    s = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", sd))])
    x = rows.join(F.broadcast(s), how="cross")  # one row
    by = lambda c: F.col(f"_s_{c}") if population else F.greatest(F.col(f"_s_{c}"), F.lit(1e-6))
    return x.withColumns({c: ratio(F.col(c) - F.col(f"_m_{c}"), by(c)) for c in cols}).select(rows.columns)


def correlation(x, y):
    """Pearson by moments; null without variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def partial_correlation(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """[r_xy, r_xy_z]: plain correlation, and that of what linear fits on z leave."""
    r = rows.agg(correlation(x, y).alias("r_xy"), correlation(x, z).alias("xz"), correlation(y, z).alias("yz"))
    rest = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select("r_xy", F.try_divide(F.col("r_xy") - F.col("xz") * F.col("yz"), rest).alias("r_xy_z"))
