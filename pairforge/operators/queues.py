"""Review queues of several kinds: routed cluster edges, score buckets, anchors and shared signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_token(threshold: float) -> str:
    """A threshold as part of a column's name: 0.735 gives 0735000."""
    return f"{threshold:.6f}".replace(".", "")


def ratio_token(ratio: float) -> str:
    """A ratio in whole per cent of three digits, as part of a name: 0.5 gives 050."""
    return f"{round(ratio * 100):03d}"


def threshold_marks(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """``df`` with a 0/1 column edge_at_* for each threshold that the score reaches; a missing score reaches none."""
    return df.withColumns({f"edge_at_{threshold_token(t)}": F.coalesce((F.col(score) >= t).cast("int"), F.lit(0)) for t in thresholds})


def is_pending(status: Column, label: Column) -> Column:
    """Whether nobody has read a row yet: no label, and a status that is blank or pending."""
    blank = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    return blank(status).isin("", "pending") & (blank(label) == "")


def is_reviewed(status: Column, label: Column) -> Column:
    return ~is_pending(status, label)


def reviewed_keys(queues: Sequence[DataFrame], key: str) -> DataFrame:
    """The keys that any of several queues (key, review_status, review_label) has a review of."""
    out = None
    for queue in queues:
        own = queue.filter(is_reviewed(F.col("review_status"), F.col("review_label"))).select(key)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def edge_bucket(contact: Column, fingerprint: Column, stratum: Column) -> Column:
    return F.when(contact | fingerprint, "identifier_anchor").when(stratum == "text_clone_primary", "template_clone").otherwise("semantic_or_structural")


def routed(edges: DataFrame, rules: Mapping[str, Mapping[str, str]] | None = None, prefix: str = "cluster") -> DataFrame:
    """Clusters' edges with their bucket, its policy, and where they go: "rereview" if they have a label, else "queue".

    ``edges`` has contact, fingerprint, stratum, cluster_rank and review_label. ``rules`` may name target_bucket and
    suggested_label for a bucket.
    """
    rules = rules or {}
    own = edges.withColumn("bucket", edge_bucket(F.col("contact"), F.col("fingerprint"), F.col("stratum")))

    def ruled(field: str, usual: Column) -> Column:
        said = [F.when(F.col("bucket") == b, F.lit(r[field])) for b, r in rules.items() if field in r]
        return F.coalesce(*said, usual)

    named = F.concat_ws("_", F.lit(prefix), F.lpad(F.col("cluster_rank").cast("string"), 4, "0"), F.col("bucket"))
    label = F.when(F.col("bucket") == "identifier_anchor", "positive_candidate").otherwise("uncertain_candidate")
    route = F.when(F.coalesce(F.trim("review_label"), F.lit("")) == "", "queue").otherwise("rereview")
    return own.withColumns({"target_bucket": ruled("target_bucket", named), "suggested_label": ruled("suggested_label", label), "route": route})


def eligible_signals(signals: DataFrame, kinds: Sequence[str], excluded: Mapping[str, Sequence[str]]) -> DataFrame:
    """Signals of the given kinds that point at an entity: direct ones without risk, and no excluded value.

    ``excluded`` lists values for each kind, and for all kinds under "*".
    """
    value = F.lower(F.trim("value"))
    out = F.lit(False)
    for kind, values in excluded.items():
        named = value.isin(*[v.strip().casefold() for v in values]) if values else F.lit(False)
        out = out | (named if kind == "*" else (F.col("kind") == kind) & named)
    return signals.filter(F.col("kind").isin(*kinds) & ~out & (F.col("direct") > 0) & (F.col("risk") == 0) & (F.col("support_only") == 0))


def signal_pairs(signals: DataFrame, *, least: int = 2, most: int = 6) -> DataFrame:
    """Pairs (left, right, kind, value, members) of entities that share a signal which ``least`` to ``most`` entities have."""
    own = signals.select(F.col("entity").alias("id"), "kind", "value").distinct()
    sizes = own.groupBy("kind", "value").agg(F.count("*").alias("members")).filter(F.col("members").between(least, most))
    here = own.join(sizes, ["kind", "value"])
    other = here.select(F.col("id").alias("right"), "kind", "value")
    return here.withColumnRenamed("id", "left").join(other, ["kind", "value"]).filter("left < right").select("left", "right", "kind", "value", "members")


def anchored(pairs: DataFrame, order: Sequence[str], limits: Mapping[str, int]) -> DataFrame:
    """Pairs (left, right, members, anchor) under the first kind of anchor in ``order`` that they have, and of each kind the rarest up to its limit.

    Adds ``anchor_rank``. A pair with several anchors of a kind counts with that of the fewest members.
    """
    place = F.coalesce(*(F.when(F.col("anchor") == a, k) for k, a in enumerate(order)))
    first = pairs.withColumn("_o", place).filter("_o is not null").groupBy("left", "right").agg(F.min(F.struct("_o", "members", "anchor")).alias("a")).select("left", "right", "a.members", "a.anchor")
    w = Window.partitionBy("anchor").orderBy("members", "left", "right")
    limit = F.coalesce(*(F.when(F.col("anchor") == a, n) for a, n in limits.items()))
    return first.withColumn("anchor_rank", F.row_number().over(w)).filter(F.col("anchor_rank") <= limit)


def capped_in_order(rows: DataFrame, order: Sequence[Column], key: str, caps: Mapping[str, int], most: int, candidates: int = 50_000) -> DataFrame:
    """Rows in order, passing over those whose value in a capped column was taken that often, until ``most`` are taken: (key, rank).

    Caps of several columns bind each other, so what is taken depends on all before and the last step runs in one task,
    over the key and the capped columns of the best ``candidates`` rows. If these don't fill ``most``, an error says so.
    """
    columns = [key, *caps]
    best = rows.orderBy(*order, key).limit(candidates).select(*columns)
    numbered = best.withColumn("_place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        used: dict[tuple, int] = {}
        kept = []
        for row in frame.sort_values("_place")[columns].itertuples(index=False):
            if len(kept) == most:
                break
            values = list(zip(caps, row[1:], strict=True))
            if all(used.get(v, 0) < caps[v[0]] for v in values):
                for v in values:
                    used[v] = used.get(v, 0) + 1
                kept.append((row[0], len(kept) + 1))
        if len(kept) < most and len(frame) >= candidates:
            raise ValueError(f"{candidates} candidates are too few to take {most} rows")
        return pd.DataFrame(kept, columns=[key, "rank"])

    return numbered.groupBy(F.lit(1).alias("_one")).applyInPandas(take, f"{key} {dict(rows.dtypes)[key]}, rank int")
