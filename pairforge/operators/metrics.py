"""Exact evaluation of scores, and statistics that compare groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.shared import stash


def running(points: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], *, ranges: int = 64) -> DataFrame:
    """``points`` with before_* for each of ``sums``: its sum over all rows of the group that come earlier in ``order``.

    Rows are cut into ranges at approximate quantiles of the order; a window runs inside a range, and what a range adds to
    those after it is one row, so no task orders a whole group. ``order`` is unique within a group, and no number is missing.
    """
    names = {c: f"_{c}" for c in by}
    cuts = points.groupBy(*by).agg(F.percentile_approx(order, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)).alias("_cuts"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or [F.lit(True)]
    side = cuts.withColumnsRenamed(names)
    placed = points.join(side if by else F.broadcast(side), same).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts", *names.values())
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    totals = placed.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_in_{c}") for c in sums))
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_in_{c}").over(over), F.lit(0)).alias(f"_off_{c}") for c in sums))
    out = placed.join(offsets, [*same, F.col("_range") == F.col("_r")] if by else F.col("_range") == F.col("_r"))
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_off_{c}") for c in sums}).drop("_range", "_r", *names.values(), *(f"_off_{c}" for c in sums))


def roc_auc(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve for each group, ties by average rank; null without both labels.

    Rows are first counted by (group, score), and sums run inside ranges of scores.
    """
    points = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    ranked = running(points, by, "_s", ["n"])
    sums = ranked.groupBy(*by).agg(F.sum(F.col("p") * (2 * F.col("before_n") + F.col("n") + 1)).alias("r2"), F.sum("p").alias("pos"), F.sum("n").alias("rows"))
    neg = F.col("rows") - F.col("pos")
    auc = F.when((F.col("pos") > 0) & (neg > 0), (F.col("r2") - F.col("pos") * (F.col("pos") + 1)) / (2 * F.col("pos") * neg))
    return sums.select(*by, "rows", F.col("pos").alias("positives"), F.round(auc, 6).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str], score: str, label: str, tie: str) -> DataFrame:
    """Mean of the precision at each positive along falling scores; equal scores go in the order of ``tie``.

    Scores are counted first and summed inside ranges; rows are ordered only among those of one score.
    """
    y = F.col(label).cast("bigint")
    points = df.groupBy(*by, (-F.col(score)).alias("_s")).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    before = running(points, by, "_s", ["n", "p"]).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_s").alias("_t"), "before_n", "before_p")
    w = Window.partitionBy(*by, "_s").orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.select(*by, (-F.col(score)).alias("_s"), F.col(tie).alias(tie), y.alias("y")).select(*by, "_s", "y", F.sum("y").over(w).alias("tp"), F.count("*").over(w).alias("k"))
    steps = rows.join(before, [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_s") == F.col("_t")])
    pos = F.sum("y")
    precision = (F.col("before_p") + F.col("tp")) / (F.col("before_n") + F.col("k"))
    return steps.groupBy(*by).agg(F.count("*").alias("rows"), F.when(pos > 0, F.round(F.sum(F.when(F.col("y") == 1, precision)) / pos, 6)).alias("average_precision"))


def confusion(df: DataFrame, by: Sequence[str], predicted: Column, label: Column) -> DataFrame:
    """Counts and rates of a prediction for each group; rates are 0 where their denominator is."""
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    p, y = predicted.cast("int"), label.cast("int")
    counts = df.groupBy(*by).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *by, "tp", "fp", "tn", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"),
        F.round((F.coalesce(F.when(tp + fn > 0, tp / (tp + fn)), F.lit(0.0)) + F.coalesce(F.when(tn + fp > 0, tn / (tn + fp)), F.lit(0.0))) / 2, 6).alias("balanced_accuracy"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def log_loss(p: Column, y: Column, eps: float = 1e-9) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.avg(-(y * F.log(inside) + (1 - y) * F.log(1 - inside)))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def threshold_scan(df: DataFrame, score: str, label: str, extra: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """Confusion counts at every distinct score, at midpoints between them, and at ``extra``: (threshold, tp, fp, tn, fn).

    What lies below each distinct score is summed inside ranges of scores; between two scores the counts are those of
    the upper one. So one list of distinct scores, cut into ranges, answers all thresholds.
    """
    points = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    kept = stash(running(points, [], "s", ["n", "p"]), "scores")
    total = kept.agg(F.sum("p").alias("pos"), F.sum("n").alias("rows"))
    # the next lower score of each: the greatest of its range, or of the ranges before
    below = kept.select(F.col("s").alias("_s"), F.col("before_n").alias("_b"), (F.col("before_n") + F.col("n")).alias("_upto"))
    mids = kept.join(below, F.col("before_n") == F.col("_upto")).select(((F.col("s") + F.col("_s")) / 2).alias("threshold"), "before_n", "before_p")
    own = kept.select(F.col("s").alias("threshold"), "before_n", "before_p")
    asked = df.sparkSession.createDataFrame([(float(x),) for x in extra], "threshold double")
    # a few fixed numbers, each looked up by an aggregate over the distinct scores
    fixed = asked.join(kept.select("s", "n", "p"), F.col("s") < F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before_n"), F.coalesce(F.sum("p"), F.lit(0)).alias("before_p"))
    both = own.unionByName(mids).unionByName(fixed).groupBy("threshold").agg(F.max("before_n").alias("bn"), F.max("before_p").alias("bp")).join(F.broadcast(total), F.lit(True))
    return both.select("threshold", (F.col("pos") - F.col("bp")).alias("tp"), (F.col("rows") - F.col("pos") - F.col("bn") + F.col("bp")).alias("fp"), (F.col("bn") - F.col("bp")).alias("tn"), F.col("bp").alias("fn"))


def _metrics(scan: DataFrame) -> DataFrame:
    """``scan`` with the metrics that thresholds are chosen by, to nine places."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 9), F.lit(0.0))
    recall, specificity = rate(tp, tp + fn), rate(tn, tn + fp)
    return scan.withColumns({
        "precision": rate(tp, tp + fp), "recall": recall, "specificity": specificity, "f1": rate(2 * tp, 2 * tp + fp + fn), "accuracy": rate(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": F.round((recall + specificity) / 2, 9), "higher_threshold": F.col("threshold"), "lower_threshold": -F.col("threshold"),
    })


# What decides between thresholds of equal metric, and between those that the guard lets through.
TIES = ("specificity", "precision", "f1", "higher_threshold")
GUARDED_TIES = ("f1", "recall", "precision", "specificity", "lower_threshold")


def best_threshold(scan: DataFrame, metric: str, *, ties: Sequence[str] = TIES, least_positive: int = 0, least_negative: int = 0, most_drop: float = 0.0, guarded_ties: Sequence[str] = GUARDED_TIES) -> DataFrame:
    """The row of the threshold of the best metric, with ties decided in order, and ``metric``.

    If it predicts fewer rows than the guard's least either way, the choice is made anew, by the guard's ties, among
    thresholds that do and whose metric is at most ``most_drop`` below the best; without any, the first choice stays.
    """
    order = lambda names: [F.desc(metric), *(F.desc(n) for n in names)]
    rows = _metrics(scan)
    enough = (F.col("tp") + F.col("fp") >= least_positive) & (F.col("tn") + F.col("fn") >= least_negative)
    first = rows.orderBy(*order(ties)).limit(1).withColumn("_turn", F.when(enough, 0).otherwise(2))
    best = rows.agg(F.max(metric).alias("_best"))
    guarded = rows.filter(enough).join(F.broadcast(best), F.lit(True)).filter(F.col("_best") - F.col(metric) <= most_drop + 1e-12).drop("_best")
    second = guarded.orderBy(*order(guarded_ties)).limit(1).withColumn("_turn", F.lit(1))
    return first.unionByName(second).orderBy("_turn").limit(1).withColumn("metric", F.col(metric)).drop("_turn", "higher_threshold", "lower_threshold")


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, population deviation, min, quartiles and max of a number's present values, for groups of any size."""
    points = exact_quantiles(df, by, value, [0.25, 0.5, 0.75])
    at = lambda p: F.round(F.max(F.when(F.col("point") == p, F.col("quantile"))), 6)
    wide = points.groupBy(*by).agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    x = F.col(value).cast("double")
    sums = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    same = [sums[c].eqNullSafe(wide[c]) for c in by]
    return sums.join(wide, same).select(*(sums[c] for c in by), "n", "mean", "median", "sd", "q25", "q75", "min", "max")


def with_baseline(rows: DataFrame, slices: Sequence[str], model: str, metric: str, baseline: str) -> DataFrame:
    """``rows`` (slices, model, metric) with the baseline model's metric of the same slice and the difference; null without one."""
    base = rows.filter(F.col(model) == baseline).select(*(F.col(c).alias(f"_{c}") for c in slices), F.col(metric).alias("baseline"))
    out = rows.join(base, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in slices], "left").drop(*(f"_{c}" for c in slices))
    return out.withColumn("delta", F.round(F.col(metric) - F.col("baseline"), 6))


def top_by(rows: DataFrame, value: Column, ties: Sequence[str], most: int) -> DataFrame:
    """The ``most`` rows of greatest value, missing ones last, with their place; ties in the order of ``ties``."""
    best = rows.withColumn("_value", value).orderBy(F.desc_nulls_last("_value"), *ties).limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("_value"), *ties))).drop("_value")


def bootstrap_threshold(df: DataFrame, score: str, label: str, metric: str, *, resamples: int = 200, seed: int = 7, take: str = "median", least_distinct: int = 3, most_points: int = 100_000) -> dict:
    """A threshold from resamples of validation rows, as many of either label as there are: threshold, used, reason, distinct.

    Each resample chooses by the metric with the usual ties; the result is the median or mean of the choices. With one
    label only, or fewer than ``least_distinct`` different choices, it is the choice on the rows themselves. Rows come to
    the driver as counts of distinct scores, of which there are few in a validation set: more than ``most_points`` are refused.
    """
    points = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n")).limit(most_points + 1).collect()
    if len(points) > most_points:
        raise ValueError(f"more than {most_points} distinct scores")
    points.sort(key=lambda r: r["s"])
    s, pos = np.array([r["s"] for r in points]), np.array([r["p"] for r in points], np.int64)
    neg = np.array([r["n"] for r in points], np.int64) - pos
    grid = np.unique(np.concatenate([s, (s[1:] + s[:-1]) / 2, [0.05, 0.95]]))

    def choose(p: np.ndarray, q: np.ndarray) -> float:
        at = np.searchsorted(s, grid)
        fn, tn = np.append(0, np.cumsum(p))[at], np.append(0, np.cumsum(q))[at]
        tp, fp = p.sum() - fn, q.sum() - tn
        rate = lambda a, b: np.round(np.divide(a, b, out=np.zeros(len(grid)), where=b > 0), 9)
        found = {"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "f1": rate(2 * tp, 2 * tp + fp + fn), "accuracy": rate(tp + tn, tp + fp + tn + fn), "higher_threshold": grid}
        found["balanced_accuracy"] = np.round((found["recall"] + found["specificity"]) / 2, 9)
        return float(grid[np.lexsort([found[t] for t in (*TIES[::-1], metric)])[-1]])

    single = choose(pos, neg)
    if not pos.sum() or not neg.sum():
        return {"threshold": single, "used": False, "reason": "one_label", "distinct": 0}
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.multinomial(n.sum(), n / n.sum())
    chosen = [choose(draw(pos), draw(neg)) for _ in range(resamples)]
    distinct = len({round(x, 6) for x in chosen})
    if distinct < least_distinct:
        return {"threshold": single, "used": False, "reason": "few_thresholds", "distinct": distinct}
    return {"threshold": float(np.median(chosen) if take == "median" else np.mean(chosen)), "used": True, "reason": "", "distinct": distinct}


def exclusive_p90(values: Column) -> Column:
    """The ninth of ten exclusive quantiles of an array of numbers, the greatest if there are fewer than ten."""
    s, n = F.array_sort(values), F.size(values)
    at = F.floor((n + 1) * 9 / 10).cast("int")
    frac = (n + 1) * 9 % 10
    at = F.least(F.greatest(at, F.lit(1)), n - 1)
    return F.when(n == 0, None).when(n < 10, F.element_at(s, -1)).otherwise((F.get(s, at - 1) * (10 - frac) + F.get(s, at) * frac) / 10)


def mean_difference(mean1: Column, var1: Column, mean2: Column, var2: Column) -> Column:
    """Difference of means in pooled population deviations; without spread 0 for equal means, else null."""
    pooled = F.sqrt((var1 + var2) / 2)
    return F.when(pooled > 0, (mean1 - mean2) / pooled).when(mean1 == mean2, 0.0)


def ks_statistic(df: DataFrame, value: str, side: Column, by: Sequence[str] = ()) -> DataFrame:
    """The greatest distance of two samples' distribution functions; ``side`` is 0 or 1, other rows are passed over."""
    points = df.select(*by, F.col(value).alias("v"), side.cast("int").alias("side")).filter("v is not null and side in (0, 1)")
    points = points.groupBy(*by, "v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    upto = running(points, by, "v", ["a", "b"])
    sums = points.groupBy(*by).agg(F.sum("a").alias("_all_a"), F.sum("b").alias("_all_b")).withColumnsRenamed({c: f"_{c}" for c in by})
    both = upto.join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else upto.join(F.broadcast(sums), F.lit(True))
    far = F.abs((F.col("before_a") + F.col("a")) / F.nullif("_all_a", F.lit(0)) - (F.col("before_b") + F.col("b")) / F.nullif("_all_b", F.lit(0)))
    return both.groupBy(*by).agg(F.round(F.max(far), 6).alias("ks"))


def ensemble(scores: list[DataFrame], key: str, score: str = "score", *, need_all: bool) -> DataFrame:
    """The mean score of each key over several tables; ``need_all`` drops keys that a table lacks."""
    every = scores[0].select(key, score)
    for other in scores[1:]:
        every = every.unionByName(other.select(key, score))
    out = every.groupBy(key).agg(F.avg(score).alias("mean_score"), F.count("*").alias("members"))
    return out.filter(F.col("members") == len(scores)) if need_all else out


def bootstrap(df: DataFrame, group: str, score: str, label: str, *, resamples: int, seed: int) -> DataFrame:
    """AUC of each resample of groups with replacement: (resample, rows, positives, auc).

    A group's number of draws is counted from hashed draws, one for each group and resample, and weighs its rows, so
    rows are never repeated. Draws depend on seed, resample and draw only, not on the partitioning.
    """
    groups = df.select(F.col(group).alias("g")).distinct()
    listed = groups.withColumn("place", F.row_number().over(Window.orderBy("g")) - 1)
    n = listed.agg(F.count("*").alias("n"))
    spark = df.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "resample").join(F.broadcast(n), F.lit(True))
    draws = draws.select("resample", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("draw"))
    picked = draws.select("resample", F.pmod(F.xxhash64(F.lit(seed), "resample", "draw"), F.col("n")).alias("place")).groupBy("resample", "place").agg(F.count("*").alias("times"))
    points = df.groupBy(F.col(group).alias("g"), F.col(score).alias("s")).agg(F.count("*").alias("n0"), F.sum(F.col(label).cast("bigint")).alias("p0"))
    rows = picked.join(listed, "place").join(points, "g").groupBy("resample", "s").agg(F.sum(F.col("n0") * F.col("times")).alias("n"), F.sum(F.col("p0") * F.col("times")).alias("p"))
    w = Window.partitionBy("resample").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    sums = ranked.groupBy("resample").agg(F.sum(F.col("p") * (2 * F.col("before") + F.col("n") + 1)).alias("r2"), F.sum("p").alias("pos"), F.sum("n").alias("rows"))
    neg = F.col("rows") - F.col("pos")
    return sums.select("resample", "rows", F.col("pos").alias("positives"), F.when((F.col("pos") > 0) & (neg > 0), (F.col("r2") - F.col("pos") * (F.col("pos") + 1)) / (2 * F.col("pos") * neg)).alias("auc"))


def interval(samples: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Mean, sample deviation and percentile interval of the valid resamples, and their number."""
    low = (1 - level) / 2
    x = F.col(value)
    return samples.filter(x.isNotNull() & ~F.isnan(x)).agg(
        F.count("*").alias("valid"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(low)).alias("low"), F.percentile(x, F.lit(1 - low)).alias("high")
    )


def sign_p(diff: Column) -> Column:
    """Two-sided sign probability of resampled differences."""
    n = F.count(diff)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.least(F.count_if(diff <= 0) / n, F.count_if(diff >= 0) / n)))


def paired_difference(one: DataFrame, other: DataFrame, value: str = "auc") -> DataFrame:
    """The difference of two metrics on the same resamples, with its interval and sign probability."""
    both = one.select("resample", F.col(value).alias("x")).join(other.select("resample", F.col(value).alias("y")), "resample").select((F.col("x") - F.col("y")).alias("diff")).filter("diff is not null")
    return both.agg(F.count("*").alias("valid"), F.avg("diff").alias("mean"), F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"), sign_p(F.col("diff")).alias("p"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], ranges: int = 64) -> DataFrame:
    """Exact quantiles by linear interpolation, for groups of any size: (*by, point, quantile).

    Values are counted first, then cut into ranges at approximate quantiles. Sums of ranges say which of them hold the
    wanted ranks; only those are ordered, each by itself. So no task orders or holds a whole group.
    """
    x = F.col(value).cast("double")
    present = df.select(*by, x.alias("v")).filter("v is not null and not isnan(v)")
    cuts = present.groupBy(*by).agg(F.percentile_approx("v", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)).alias("cuts"), F.count("*").alias("total"))
    counts = present.groupBy(*by, "v").agg(F.count("*").alias("n"))
    names = {c: f"_{c}" for c in by}
    side = cuts.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or [F.lit(True)]
    placed = counts.join(F.broadcast(side) if not by else side, same).drop(*names.values()).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = placed.groupBy(*by, "range").agg(F.sum("n").alias("inside"), F.first("total").alias("total"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranks = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("point"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for p in points)))
    wanted = sums.withColumn("before", F.coalesce(F.sum("inside").over(order), F.lit(0))).select(*by, "range", "before", "inside", "total", ranks.alias("p")).select("*", "p.point", "p.at", F.explode(F.array(F.floor("p.at"), F.least(F.floor("p.at") + 1, F.col("total") - 1))).alias("rank"))
    wanted = wanted.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("inside"))).distinct()
    within = Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    needed = wanted.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("range").alias("_range")).distinct()
    steps = placed.join(needed, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("range") == F.col("_range")], "left_semi").withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    target = wanted.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("range").alias("_range"), "before", "point", "at", "rank")
    hit = steps.join(target, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("range") == F.col("_range")])
    hit = hit.filter((F.col("rank") >= F.col("before") + F.col("start")) & (F.col("rank") < F.col("before") + F.col("start") + F.col("n")))
    share = F.col("at") - F.floor("at")
    low, high = F.min(F.struct("rank", "v"))["v"], F.max(F.struct("rank", "v"))["v"]
    return hit.groupBy(*by, "point").agg((low + F.first(share) * (high - low)).alias("quantile"))
