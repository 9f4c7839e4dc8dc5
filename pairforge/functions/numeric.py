"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """A double to so many places as DuckDB does it: x * 10^places to the nearest whole number, halves away from zero.

    ``F.round`` goes by the shortest decimal text and differs where the product is just below a half: 41/640 is 0.064063
    there and 0.064062 here. A last place off moves scores past each other, and so the ranks of all rows between them.
    """
    scale = float(10**places)
    return F.round(x * scale) / scale


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b to six places, 0 where b is 0 or missing."""
    return F.coalesce(F.when(b != 0, F.round(a / b, 6)), F.lit(0.0))


def closeness(a: Column, b: Column) -> Column:
    """The smaller over the larger of two positive numbers, else null."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def l1(a: list[Column], b: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def structural_support(category: Column, style_gap: Column, size_ratio: Column, price_ratio: Column) -> Column:
    """Mean of category overlap, likeness of style, likeness of size and, if known, likeness of price.

    Styles whose shares differ by 2 in all are not alike at all. A missing size ratio counts as 0; a missing price ratio
    is left out of the mean.
    """
    three = category + F.greatest(F.lit(0.0), 1 - F.least(style_gap / 2, F.lit(1.0))) + F.coalesce(size_ratio, F.lit(0.0))
    return F.when(price_ratio.isNull(), three / 3).otherwise((three + price_ratio) / 4)


def idf(total: Column, df: Column) -> Column:
    return F.log((total + 1) / (df + 1)) + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two maps of weights: the sum of products over what the smaller has and the other too."""
    of = lambda small, large: F.aggregate(F.map_entries(small), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(large, e["key"]), F.lit(0.0)))
    return F.when(F.size(a) <= F.size(b), of(a, b)).otherwise(of(b, a))


def sparse_cosine(a: Column, b: Column) -> Column:
    """The cosine of two maps of weights; 0 if either is empty or missing."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    both = norm(a) * norm(b)
    return F.coalesce(F.when(both > 0, sparse_dot(a, b) / both), F.lit(0.0))


def logit(p: Column, eps: float = 1e-6) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(inside / (1 - inside))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def median_of(values: Column) -> Column:
    """The median of an array; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)


def style_consistency(gaps: list[Column]) -> Column:
    """1 less the median gap, gaps clipped to [0, 1]; a missing gap counts as 0, that is as agreement."""
    return 1 - median_of(F.array(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(g, F.lit(0.0)))) for g in gaps)))


def rank_score(contacts: Column, descriptions: Column, fingerprints: Column, titles: Column, lexical: Column, support: Column, same_alias: Column) -> Column:
    """Linear score of a candidate pair: fixed weights for each kind of evidence."""
    has = lambda n: F.when(n > 0, 1.0).otherwise(0.0)
    return 6 * has(contacts) + 5 * has(descriptions) + 4.5 * has(fingerprints) + 2 * F.least(titles, F.lit(3)) + 6 * lexical + 2 * support - F.when(same_alias, 0.5).otherwise(0.0)


def review_priority(contacts: Column, descriptions: Column, fingerprints: Column, titles: Column, lexical: Column, support: Column) -> Column:
    """How soon a candidate pair should be read."""
    return (
        F.when((contacts > 0) | (descriptions > 0) | (fingerprints > 0), "high")
        .when((titles > 0) & ((lexical >= 0.16) | (support >= 0.6)), "high")
        .when((lexical >= 0.22) | ((titles > 0) & (support >= 0.5)), "medium")
        .otherwise("low")
    )


# Weights of a relation's evidence, its base, the bounds of that evidence and the least reliability of an edge.
RELIABILITY = {
    "shared_pgp_fingerprint": 0.45, "shared_seller_contact": 0.35, "rare_description_clone": 0.15, "rare_title_clone": 0.10, "rare_ngram_support": 0.08, "structural_support": 0.12,
    "style_consistency": 0.08, "boilerplate_template_penalty": -0.20, "semantic_topic_only_penalty": -0.25,
}
RELIABILITY_BASE = 0.2
RELIABILITY_BOUNDS = {
    "rare_description_idf_mean": 2.0, "rare_title_idf_mean": 2.0, "rare_ngram_count": 2.0, "structural_support": 0.5, "category_jaccard": 0.5, "style_consistency": 0.72,
    "boilerplate_ratio_max": 0.75, "shared_boilerplate_count": 3.0, "semantic_topic_similarity": 0.75,
}
LEAST_RELIABILITY = 0.3


def reliability(
    *, fingerprints: Column, contacts: Column, description_clone: Column, description_idf: Column, title_clone: Column, title_idf: Column, rare_ngrams: Column, support: Column, category: Column, style: Column,
    boilerplate_ratio: Column, boilerplate_count: Column, semantic: Column, weights: dict[str, float] = RELIABILITY, bounds: dict[str, float] = RELIABILITY_BOUNDS, base: float = RELIABILITY_BASE,
) -> Column:
    """How far a pair's relation can be trusted, as a struct: score (0 to 1), components, direct, topic_only.

    The base plus the weights of the evidence that holds; a trace names each part with its weight. Missing numbers count
    as 0, missing marks as not set. ``direct`` is a shared fingerprint or contact, ``topic_only`` a likeness of meaning
    without anything else.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mark = lambda c: F.coalesce(c, F.lit(False))
    structural = (zero(support) >= bounds["structural_support"]) | (zero(category) >= bounds["category_jaccard"])
    direct = (zero(fingerprints) > 0) | (zero(contacts) > 0)
    topic_only = (zero(semantic) >= bounds["semantic_topic_similarity"]) & ~direct & ~(mark(description_clone) | mark(title_clone) | structural)
    holds = {
        "shared_pgp_fingerprint": zero(fingerprints) > 0,
        "shared_seller_contact": zero(contacts) > 0,
        "rare_description_clone": mark(description_clone) & (zero(description_idf) >= bounds["rare_description_idf_mean"]),
        "rare_title_clone": mark(title_clone) & (zero(title_idf) >= bounds["rare_title_idf_mean"]),
        "rare_ngram_support": zero(rare_ngrams) >= bounds["rare_ngram_count"],
        "structural_support": structural,
        "style_consistency": zero(style) >= bounds["style_consistency"],
        "boilerplate_template_penalty": (zero(boilerplate_ratio) >= bounds["boilerplate_ratio_max"]) | (zero(boilerplate_count) >= bounds["shared_boilerplate_count"]),
        "semantic_topic_only_penalty": topic_only,
    }
    total = sum((F.when(c, weights[k]).otherwise(0.0) for k, c in holds.items()), F.lit(base))
    said = {k: f"+{k}:{w:.3f}" if w >= 0 else f"{w:.3f}:{k}" for k, w in weights.items()}
    trace = F.array_compact(F.array(*(F.when(c, F.lit(said[k])) for k, c in holds.items())))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)
    return F.struct(score.alias("score"), trace.alias("components"), direct.alias("direct"), topic_only.alias("topic_only"))


def greatest_of(*scores: Column) -> Column:
    """The greatest of several scores, missing ones as 0; 0 without any."""
    return F.greatest(F.lit(0.0), *(F.coalesce(s.cast("double"), F.lit(0.0)) for s in scores)) if scores else F.lit(0.0)
