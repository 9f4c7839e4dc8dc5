"""Rolling items up into entity profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(items: DataFrame, entity: Sequence[str], value: str, order: str) -> DataFrame:
    """How often each entity has each non-blank value, and where it came first: (*entity, value, count, first_seen)."""
    rows = items.select(*entity, F.col(value).alias("value"), F.col(order).alias("_order")).filter(F.trim("value") != "")
    return rows.groupBy(*entity, "value").agg(F.count("*").alias("count"), F.min("_order").alias("first_seen"))


def top_values(counts: DataFrame, entity: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values of each entity, ties to the earlier and then the lesser, with their rank from 1."""
    w = Window.partitionBy(*entity).orderBy(F.desc("count"), "first_seen", "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def signature_values(counts: DataFrame, entity: Sequence[str], total: Column, k: int, *, least_df: int = 1, most_df: int | None = None) -> DataFrame:
    """The k most specific values of each entity: (*entity, value, count, entity_df, specificity, rank).

    Specificity is log(1 + count) times the inverse document frequency over entities; ties go to the greater count,
    then to the value seen last, then to the lesser one.
    """
    df = counts.groupBy("value").agg(F.count("*").alias("entity_df"))
    df = df.filter(F.col("entity_df") >= least_df)
    if most_df is not None:
        df = df.filter(F.col("entity_df") <= most_df)
    scored = counts.join(df, "value").withColumn("specificity", F.log1p("count") * (F.log((total + 1) / (F.col("entity_df") + 1)) + 1))
    w = Window.partitionBy(*entity).orderBy(F.desc(F.round("specificity", 9)), F.desc("count"), F.desc("first_seen"), "value")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# Reasons to leave an item out, in the order in which they name an entity that has nothing else.
REASONS = ("alias", "key", "contact", "script", "other")
ENTITY_REASONS = {"alias": "alias_overlap", "key": "key_overlap", "contact": "contact_overlap", "script": "no_eligible_items_after_script_filter"}


def entity_buckets(items: DataFrame, entity: str) -> DataFrame:
    """Each entity's items by bucket and reason, and the bucket and reason that they give the entity.

    ``items`` has bucket (source, strict, aux, excluded) and reason. The target's buckets go before the source's; an
    entity of the source that lost items for a reason of its own is marked as partly excluded.
    """
    counts = items.groupBy(entity).agg(
        F.count("*").alias("items"), *(F.count_if(F.col("bucket") == b).alias(b) for b in ("source", "strict", "aux")), *(F.count_if((F.col("bucket") == "excluded") & (F.col("reason") == r)).alias(f"excluded_{r}") for r in REASONS)
    )
    some = F.col("excluded_alias") + F.col("excluded_key") + F.col("excluded_contact") + F.col("excluded_script") > 0
    bucket = F.when(F.col("strict") > 0, "strict").when(F.col("aux") > 0, "aux").when(F.col("source") > 0, "source").otherwise("excluded")
    first = F.coalesce(*(F.when(F.col(f"excluded_{r}") > 0, said) for r, said in ENTITY_REASONS.items()), F.lit("no_eligible_items"))
    reason = F.when(bucket.isin("strict", "aux"), "").when(bucket == "source", F.when(some, "partial_item_exclusion").otherwise("")).otherwise(first)
    return counts.withColumn("bucket", bucket).withColumn("reason", reason)


def number_stats(x: Column) -> Column:
    """count, min, median and max of a number as a struct, over a group."""
    return F.struct(F.count(x).alias("count"), F.min(x).alias("min"), F.median(x).alias("median"), F.max(x).alias("max"))


def nested(top: DataFrame, entity: Sequence[str], name: str) -> DataFrame:
    """Ranked values as one array of (value, count) for each entity; their number is bounded by the rank's limit."""
    return top.groupBy(*entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))), lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))).alias(name))


def term_weights(terms: DataFrame, entity: str, total: int | Column, k: int, *, least_df: int = 2, most_share: float = 0.5, most_df: int = 10_000) -> DataFrame:
    """Sparse vectors of entities from (entity, term, tf): (entity, term, weight, rank), the k heaviest terms of each.

    Terms outside the band of document frequencies are left out, which also bounds the lists of an inverted index.
    Weight is (1 + ln(1 + tf)) times the inverse document frequency, to nine places so that ties are ties anywhere.
    """
    n = F.lit(total) if isinstance(total, int) else total
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    df = df.filter((F.col("df") >= least_df) & (F.col("df") <= F.least(n * most_share, F.lit(most_df))))
    own = terms.join(df, "term").withColumn("weight", F.round((1 + F.log1p("tf")) * (F.log((n + 1) / (F.col("df") + 1)) + 1), 9))
    w = Window.partitionBy(entity).orderBy(F.desc("weight"), "term")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(entity, "term", "weight", "rank")
