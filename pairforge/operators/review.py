"""Review queues: strata, ranks, applying decisions, freezing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.operators.ranks import global_rank


def balanced_queue(df: DataFrame, stratum: str, order: Sequence[Column], strata_order: Sequence[str] | None = None) -> DataFrame:
    """Rows of all strata in turn: the first of each, then the second of each, and so on; adds ``turn`` and ``queue_rank``.

    A row's rank is the number of rows of earlier turns, from one row for each turn, plus its place among the strata
    that reach its turn; so no window runs over the whole queue.
    """
    first = F.array_position(F.array(*map(F.lit, strata_order)), F.col(stratum)) if strata_order else F.lit(0)
    # a row's turn is its place in the order of all strata one after another, less that of its stratum's first row
    placed = global_rank(df, [F.col(stratum).asc_nulls_first(), *order], "_queue_place")
    firsts = placed.groupBy(F.col(stratum).alias("_stratum")).agg(F.min("_queue_place").alias("_from"))
    ranked = placed.join(F.broadcast(firsts), F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn("turn", (F.col("_queue_place") - F.col("_from") + 1).cast("int")).drop("_queue_place", "_from", "_stratum")
    sizes = ranked.groupBy(F.col(stratum).alias("_s")).agg(F.max("turn").alias("_n"))
    names = sizes.select("_s", "_n").withColumn("_o", F.array_position(F.array(*map(F.lit, strata_order)), F.col("_s")) if strata_order else F.lit(0))
    # one row for each stratum: all strata's sizes in order, as an array
    listed = names.agg(F.array_sort(F.collect_list(F.struct("_o", "_s", "_n"))).alias("_all"))
    out = ranked.withColumn("_first", first).join(F.broadcast(listed), F.lit(True))
    before = F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, s: a + F.least(s["_n"].cast("bigint"), F.col("turn").cast("bigint") - 1))
    here = F.size(F.filter("_all", lambda s: (s["_n"] >= F.col("turn")) & ((s["_o"] < F.col("_first")) | ((s["_o"] == F.col("_first")) & (s["_s"] <= F.col(stratum))))))
    return out.withColumn("queue_rank", before + here).drop("_first", "_all")


def head_and_tail(df: DataFrame, order: Sequence[Column], reverse: Sequence[Column], head: int, tail: int) -> DataFrame:
    """The first ``head`` and last ``tail`` rows, a row in both as part of the head."""
    a = df.orderBy(*order).limit(head).withColumn("part", F.lit("head"))
    b = df.orderBy(*reverse).limit(tail).withColumn("part", F.lit("tail"))
    keys = [c for c in df.columns]
    return a.unionByName(b.join(a.select(*keys), keys, "left_anti"))


def upsert(current: DataFrame, reviews: DataFrame, key: str, columns: Sequence[str], label: str, *, missing: str = "insert", overwrite: bool = False) -> DataFrame:
    """``current`` with reviews applied: updated where they say something, labelled rows kept unless ``overwrite``.

    A reviewed key that ``current`` lacks is inserted, skipped, or an error ("insert", "skip", "error"). Adds
    ``action``: inserted, updated, kept_labelled, skipped or unchanged; where keys may be skipped also ``reason``, why.
    """
    if missing == "error" and not reviews.join(current, key, "left_anti").isEmpty():
        raise ValueError("reviews name keys that are not in the queue")
    old = current.select(F.col(key), F.lit(True).alias("_old"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    new = reviews.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    both = old.join(new, key, "full")
    has = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    frozen = F.col("_old").isNotNull() & has(f"_o_{label}") & F.lit(not overwrite)
    action = (
        F.when(F.col("_old").isNull(), "inserted" if missing == "insert" else "skipped").when(F.col("_new").isNull(), "unchanged").when(frozen, "kept_labelled").otherwise("updated")
    )
    out = both.withColumn("action", action)
    if missing != "insert":
        skipped = F.col("action") == "skipped"
        out = out.filter(~skipped) if missing == "error" else out.withColumn("reason", F.when(skipped, "not_in_queue"))
    use = (F.col("action") == "inserted") | (F.col("action") == "updated")
    return out.select(key, *(F.when(use & has(f"_n_{c}"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in columns), "action", *(["reason"] if missing == "skip" else []))


def overridden(rows: DataFrame, defaults: DataFrame, overrides: DataFrame, bucket: str, key: str, value: str) -> DataFrame:
    """``rows`` with a decision: the key's own, else that of its bucket, else null; and where it came from."""
    a = defaults.select(bucket, F.col(value).alias("_default"))
    b = overrides.select(key, F.col(value).alias("_own"))
    out = rows.join(a, bucket, "left").join(b, key, "left")
    source = F.when(F.col("_own").isNotNull(), "override").when(F.col("_default").isNotNull(), "bucket").otherwise("none")
    return out.withColumn(value, F.coalesce("_own", "_default")).withColumn("decided_by", source).drop("_own", "_default")


def appended_ranks(new: DataFrame, existing: DataFrame, rank: str, order: Sequence[Column]) -> DataFrame:
    """New rows ranked after the greatest existing rank. New rows are the few that one review brought."""
    top = existing.agg(F.coalesce(F.max(rank), F.lit(0)).alias("_top"))
    return new.withColumn(rank, F.row_number().over(Window.orderBy(*order))).join(F.broadcast(top), F.lit(True)).withColumn(rank, F.col(rank) + F.col("_top")).drop("_top")


def first_bucket(rows: DataFrame, buckets: dict[str, Column], limits: dict[str, int], key: str, order: Sequence[Column]) -> DataFrame:
    """Each row in the first bucket whose condition it meets, and of each bucket the best up to its limit."""
    choice = None
    for name, condition in buckets.items():
        choice = F.when(condition, name) if choice is None else choice.when(condition, name)
    chosen = rows.withColumn("bucket", choice).filter("bucket is not null")
    limit = F.coalesce(*(F.when(F.col("bucket") == n, k) for n, k in limits.items()))
    w = Window.partitionBy("bucket").orderBy(*order, key)
    return chosen.withColumn("bucket_rank", F.row_number().over(w)).filter(F.col("bucket_rank") <= limit)


# What a cluster's evidence allows to say, with how much confidence, and what it may be used for.
DECISIONS = {
    "same_controller_high_confidence": ("high", "can_support_same_controller_core_claim"),
    "same_controller_core_with_possible_expansion": ("high", "use_only_identifier_core_for_claim; review_expansion_edges_separately"),
    "partial_anchor": ("medium", "retain_anchor_pair/core; do_not_claim_full_cluster_without_pair_level_rereview"),
    "uncertain": ("low", "manual_review_before_claim"),
    "template_clone_not_controller": ("low", "use_for_review_discovery_only"),
    "semantic_topic_not_controller": ("low", "use_for_review_discovery_only"),
}


def cluster_decision(edges: Column, proof: Column, identifiers: Column, contacts: Column, fingerprints: Column, titles: Column, descriptions: Column, text_strata: Column, semantic_strata: Column) -> Column:
    """A cluster's reading from counts of its edges by evidence, as a struct of decision, confidence and use.

    Edges that a review proved come first: all of them, two or more, one. Then identifiers without proof, then clones
    and likeness of meaning, if at least half of the edges have them.
    """
    made = lambda name: F.struct(F.lit(name).alias("decision"), F.lit(DECISIONS[name][0]).alias("confidence"), F.lit(DECISIONS[name][1]).alias("use"))
    half = lambda n: (edges > 0) & (n / F.greatest(edges, F.lit(1)) >= 0.5)
    return (
        F.when((edges > 0) & (proof == edges), made("same_controller_high_confidence"))
        .when(proof >= 2, made("same_controller_core_with_possible_expansion"))
        .when(proof == 1, made("partial_anchor"))
        .when((identifiers > 0) | (contacts + fingerprints > 0), made("uncertain"))
        .when(half(F.greatest(titles, descriptions, text_strata)), made("template_clone_not_controller"))
        .when(half(semantic_strata), made("semantic_topic_not_controller"))
        .otherwise(made("uncertain"))
    )


# The strata of evidence, in the order of a review queue.
STRATA = ("identifier_plus_text", "text_clone_primary", "semantic_structural", "identifier_primary", "semantic_only", "same_alias_continuity")


def evidence_stratum(same_alias: Column, contacts: Column, fingerprints: Column, titles: Column, descriptions: Column, lexical: Column, support: Column, structural: float = 0.5) -> Column:
    """What kind of evidence carries a pair."""
    identifier, clone = (contacts > 0) | (fingerprints > 0), (titles > 0) | (descriptions > 0)
    return (
        F.when(same_alias, "same_alias_continuity")
        .when(identifier & clone, "identifier_plus_text")
        .when(clone, "text_clone_primary")
        .when(identifier, "identifier_primary")
        .when((lexical > 0) & (support >= structural), "semantic_structural")
        .otherwise("semantic_only")
    )
