"""Checks of tables that raise or report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A table does not hold what a step needs."""


def need_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise CheckFailed(f"missing columns: {missing}")
    return df


def need_unique(df: DataFrame, key: str) -> DataFrame:
    bad = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull() | (F.col(key).cast("string") == "")).limit(3).collect()
    if bad:
        raise CheckFailed(f"blank or repeated keys, such as {[r[0] for r in bad]}")
    return df


def need_references(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    bad = df.join(other, df[key] == other[other_key], "left_anti").limit(3).collect()
    if bad:
        raise CheckFailed(f"keys without a row on the other side, such as {[r[key] for r in bad]}")
    return df


def need_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column has a finite value somewhere."""
    counts = df.agg(*(F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))).alias(c) for c in columns)).first()
    if empty := [c for c in columns if not counts[c]]:
        raise CheckFailed(f"columns without a value: {empty}")
    return df


def need_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise CheckFailed("no rows")
    return df


def overlaps(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that two splits share: (split_a, split_b, shared), a row for each pair of splits with any."""
    own = df.select(F.col(split).alias("s"), F.col(key).alias("k")).filter("k is not null").distinct()
    by_key = own.groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("all")).filter(F.size("all") > 1)
    pairs = by_key.select(F.explode(F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))).alias("p"))
    return pairs.groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


def need_no_overlap(df: DataFrame, split: str, key: str) -> DataFrame:
    if found := overlaps(df, split, key).limit(3).collect():
        raise CheckFailed(f"splits share keys: {[tuple(r) for r in found]}")
    return df


def reconciled(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides' counts by key, missing ones as 0, and whether they agree."""
    a = expected.select(key, F.col(value).alias("expected"))
    b = observed.select(key, F.col(value).alias("observed"))
    both = a.join(b, key, "full").fillna(0, ["expected", "observed"])
    return both.withColumn("agrees", F.col("expected") == F.col("observed"))


def coverage(counts: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``required`` (keys, least) with what is there and whether it is enough."""
    out = required.join(counts, list(keys), "left").withColumn("found", F.coalesce("n", F.lit(0))).drop("n")
    return out.withColumn("enough", F.col("found") >= F.col("least"))


def coverage_by_severity(rows: DataFrame, required: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """``required`` (keys, split, severity, least_in_pool) with what the pool and the split have, and ``status``.

    A requirement holds only if the pool has as many rows; then a split without any gives the requirement's severity.
    """
    pool = rows.groupBy(*keys).agg(F.count("*").alias("in_pool"))
    here = rows.groupBy(*keys, split).agg(F.count("*").alias("found"))
    out = required.join(pool, list(keys), "left").join(here, [*keys, split], "left").fillna(0, ["in_pool", "found"])
    status = F.when(F.col("in_pool") < F.col("least_in_pool"), "not_required").when(F.col("found") > 0, "covered").otherwise(F.col("severity"))
    return out.withColumn("status", status).drop("least_in_pool")


def missing_fields(df: DataFrame, mapping: dict[str, str]) -> list[str]:
    """The fields of a source's mapping (field -> column, dots inside structs) that the table does not have, in order."""

    def has(schema, path: list[str]) -> bool:
        found = {f.name: f.dataType for f in getattr(schema, "fields", [])}
        return path[0] in found and (len(path) == 1 or has(found[path[0]], path[1:]))

    return [name for name, column in mapping.items() if not has(df.schema, column.split("."))]


def acceptance(checks: dict[str, bool]) -> dict:
    """Named results of a step's checks, with ``all_passed`` and the failed names."""
    return {**checks, "all_passed": all(checks.values()), "failed": sorted(k for k, ok in checks.items() if not ok)}


def sorted_thresholds(values: Sequence[float]) -> list[float]:
    if bad := [v for v in values if not 0 <= v <= 1]:
        raise CheckFailed(f"thresholds outside 0 to 1: {bad}")
    return sorted(set(values))
