"""Clusters of a filtered graph: their edges' evidence, ranks, members and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.operators.graph import symmetric


def inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges (a, b, ...) whose both ends lie in one cluster of (id, component), with that component."""
    left = members.select(F.col("id").alias("a"), "component")
    right = members.select(F.col("id").alias("b"), F.col("component").alias("_other"))
    return edges.join(left, "a").join(right, "b").filter("component = _other").drop("_other")


def edge_evidence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For each cluster the number of its edges, and of those with each kind of evidence.

    ``edges`` has a, b, score, stratum and the marks proof, contact, fingerprint, title and description.
    """
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    strata = lambda *names: F.col("stratum").isin(*names)
    identifier = F.col("contact") | F.col("fingerprint") | strata("identifier_plus_text", "identifier_primary")
    return inside(edges, members).groupBy("component").agg(
        F.count("*").alias("edges"), count(F.col("proof")).alias("proof"), count(identifier).alias("identifiers"), count(F.col("contact")).alias("contacts"),
        count(F.col("fingerprint")).alias("fingerprints"), count(F.col("title")).alias("titles"), count(F.col("description")).alias("descriptions"),
        count(strata("text_clone_primary")).alias("text_strata"), count(strata("semantic_structural", "semantic_only")).alias("semantic_strata"), F.round(F.avg("score"), 6).alias("score_mean"),
    )


def label_class(label: Column, usable: Column, fingerprints: Column, contact_values: Column, notes: Column, prefixes: tuple[str, ...], good: tuple[str, ...], bad: tuple[str, ...]) -> Column:
    """What the review of an edge's pair proves: proof_positive, nonproof_positive, negative, uncertain, blank or missing.

    A positive, usable review is proof with a shared fingerprint, with a shared contact of the given prefixes, or with an
    e-mail whose notes hold one of the good terms and none of the bad ones. A null label is a missing review.
    """
    any_in = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)) if words else F.lit(False)
    values, said = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (contact_values, notes))
    kind = any_in(values, prefixes) | (F.contains(values, F.lit("email:")) & any_in(said, good) & ~any_in(said, bad))
    proof = (label == "positive") & F.coalesce(usable, F.lit(False)) & ((F.coalesce(fingerprints, F.lit(0)) > 0) | kind)
    return F.when(label.isNull(), "missing").when(F.trim(label) == "", "blank").when(proof, "proof_positive").when(label == "positive", "nonproof_positive").otherwise(label)


def cluster_ranks(stats: DataFrame) -> DataFrame:
    """Clusters by size, then greatest and mean score, falling, then least member: adds ``rank``. One row for each cluster.

    Ranks are counted by size first, so that a window holds the clusters of one size and not all of them.
    """
    sizes = stats.groupBy("size").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("size").alias("_size"), "_before")
    own = Window.partitionBy("size").orderBy(F.desc("max_score"), F.desc("mean_score"), "component")
    return stats.join(offsets, F.col("size") == F.col("_size")).withColumn("rank", F.row_number().over(own) + F.col("_before")).drop("_size", "_before")


# The classes of cluster sizes, as (name, least, most).
SIZES = (("size_2", 2, 2), ("size_3_to_5", 3, 5), ("size_6_to_10", 6, 10), ("size_11_plus", 11, None))


def size_class(size: Column) -> Column:
    out = None
    for name, least, most in SIZES:
        within = (size >= least) & (size <= most) if most else size >= least
        out = F.when(within, name) if out is None else out.when(within, name)
    return out


def member_table(edges: DataFrame, members: DataFrame, top: int = 3) -> DataFrame:
    """(component, id, rank, degree, score_sum, score_mean, score_max, strongest): members by degree, best score, id.

    The mean is that of scores to six places, cut to six places.
    """
    own = inside(edges, members)
    both = own.select("component", F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(own.select("component", F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    near = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= top, F.struct("_k", "other")))), lambda v: v["other"].cast("string"))
    stats = both.withColumn("_k", F.row_number().over(near)).groupBy("component", "id").agg(
        F.count("*").alias("degree"), F.round(F.sum("score"), 6).alias("score_sum"), (F.floor(F.sum(F.round(F.col("score") * 1_000_000).cast("bigint")) / F.count("*")) / 1_000_000).alias("score_mean"), F.max("score").alias("score_max"), F.array_join(named, " || ").alias("strongest")
    )
    w = Window.partitionBy("component").orderBy(F.desc("degree"), F.desc("score_max"), "id")
    return stats.withColumn("rank", F.row_number().over(w))


def run_overlap(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """How alike two runs' rows are by their keys: in the first, in the second, in both, and the Jaccard similarity."""
    a, b = one.select(*keys).distinct().withColumn("_a", F.lit(1)), other.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full").agg(F.count("_a").alias("first"), F.count("_b").alias("second"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"))
    union = F.col("first") + F.col("second") - F.col("both")
    return both.withColumn("jaccard", F.when(union > 0, F.round(F.col("both") / union, 6)).otherwise(0.0))


def merged_appearances(rows: DataFrame, group: str, counters: list[str], labels: str) -> DataFrame:
    """One row for each member set over runs: appearances, the greatest of each counter, and summed counts by label as "name:n|...".

    ``labels`` is a map column of counts.
    """
    each = rows.select(group, F.explode(labels).alias("_k", "_v")).groupBy(group, "_k").agg(F.sum("_v").alias("_v"))
    said = each.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda v: F.concat(v["_k"], F.lit(":"), v["_v"].cast("string"))), "|").alias(labels))
    best = rows.groupBy(group).agg(F.count("*").alias("appearances"), *(F.max(c).alias(f"max_{c}") for c in counters))
    return best.join(said, group, "left")


def proof_ends(pairs: DataFrame, proof: Column) -> DataFrame:
    """The entities that stand in a proved pair (left, right), with the number of such pairs."""
    return pairs.filter(proof).select(F.explode(F.array("left", "right")).alias("entity")).groupBy("entity").agg(F.count("*").alias("proved_pairs"))


def retained_edges(scored: DataFrame, flag: str, threshold: float) -> DataFrame:
    """Of a run's stored pairs those that its summary's threshold kept: by the stored mark, else by probability."""
    return scored.filter(F.col(flag).cast("int") == 1) if flag in scored.columns else scored.filter(F.coalesce(F.col("prob_positive"), F.lit(0.0)) >= threshold)


def graph_agrees(edges: DataFrame, members: DataFrame, summary: dict) -> list[str]:
    """What of a graph differs from its summary: names of "edges", "nodes", "clusters" whose counts disagree, and loops."""
    found = {
        "edges": edges.count(), "nodes": symmetric(edges).select("src").distinct().count(), "clusters": members.select("component").distinct().count(), "loops": edges.filter("a = b").count(),
    }
    return [k for k, n in found.items() if n != summary.get(k, 0 if k == "loops" else n)]
