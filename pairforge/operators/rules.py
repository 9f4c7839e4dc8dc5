"""Filters, orders and decisions that a configuration names, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TESTS = {
    "min": lambda c, v: c >= v, "max": lambda c, v: c <= v, "above": lambda c, v: c > v, "below": lambda c, v: c < v, "equals": lambda c, v: c == v, "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v), "present": lambda c, v: c.isNotNull() == v, "matches": lambda c, v: c.rlike(v), "starts": lambda c, v: any_of([c.startswith(p) for p in v]),
}


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def condition(config: Mapping[str, Mapping]) -> Column:
    """{"column": {"min": 1, "in": [...]}} as one condition: all must hold, and a missing value fails."""
    out = F.lit(True)
    for column, tests in config.items():
        for name, value in tests.items():
            out = out & F.coalesce(_TESTS[name](F.col(column), value), F.lit(False))
    return out


def ordering(config: Sequence[str]) -> list[Column]:
    """["-score", "id", "~5:size"]: falling, rising, and nearest to a number first; missing values last."""
    out = []
    for item in config:
        if item[0] == "-":
            out.append(F.desc_nulls_last(item[1:]))
        elif item[0] == "~":
            at, column = item[1:].split(":", 1)
            out.append(F.asc_nulls_last(F.abs(F.col(column) - float(at))))
        else:
            out.append(F.asc_nulls_last(item))
    return out


def decided(rules: Sequence[tuple[Column, str, str]], default: tuple[str, str]) -> Column:
    """The first rule that holds, as a struct of its label, reason and place; the default's place is 0."""
    made = lambda label, reason, k: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), F.lit(k).alias("rule"))
    out = None
    for k, (when, label, reason) in enumerate(rules, 1):
        out = F.when(when, made(label, reason, k)) if out is None else out.when(when, made(label, reason, k))
    return made(*default, 0) if out is None else out.otherwise(made(*default, 0))


def issues(checks: Mapping[str, Column]) -> Column:
    """The names of all checks that a row fails, in order; a check without an answer fails too."""
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in checks.items())))


def resolved_thresholds(scores: DataFrame, score: str, wanted: Sequence[float], quantiles: Sequence[float], least_rows: int) -> list[float]:
    """The wanted thresholds that ``least_rows`` scores reach; if none does, the quantiles of the scores instead."""
    counts = scores.agg(*(F.count_if(F.col(score) >= t).alias(f"t{i}") for i, t in enumerate(wanted)), F.percentile(score, F.array(*map(F.lit, quantiles))).alias("q")).first()
    kept = [t for i, t in enumerate(wanted) if counts[f"t{i}"] >= least_rows]
    return sorted(set(kept or [round(q, 6) for q in counts["q"] or []]))


def guarded(policy: Mapping, rows: int, guards: Sequence[tuple[int, Mapping]]) -> dict:
    """A training policy with the changes of every guard whose number of rows is not reached; later ones win."""
    out = dict(policy)
    for least, change in guards:
        if rows < least:
            out |= change
    return out


def run_summary(runs: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Runs, mean, least and greatest of a metric for each setting."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg(metric), 6).alias("mean"), F.min(metric).alias("least"), F.max(metric).alias("greatest"))


def family_scores(scores: DataFrame, key: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each key the least, mean and greatest score of each family of scorers, from (key, scorer, score)."""
    aggs = []
    for family, names in families.items():
        own = F.when(F.col("scorer").isin(*names), F.col("score"))
        aggs += [F.min(own).alias(f"{family}_min"), F.round(F.avg(own), 9).alias(f"{family}_mean"), F.max(own).alias(f"{family}_max")]
    return scores.groupBy(key).agg(*aggs)


def alias_edges(rows: DataFrame, key: str, alias: str) -> DataFrame:
    """Edges (a, b) from the least key of each non-blank alias to all of its keys: components join equal aliases."""
    own = rows.filter(F.trim(alias) != "").select(F.col(key).alias("b"), F.col(alias).alias("_alias")).distinct()
    first = own.groupBy("_alias").agg(F.min("b").alias("a"))
    return own.join(first, "_alias").filter("a <> b").select("a", "b")


def best_appearance(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Of each group the first row in a configured order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*ordering(order)))).filter("_k = 1").drop("_k")
