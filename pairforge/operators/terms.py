"""Terms that entities are compared by: segments of descriptions and weighted retrieval terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import text

# The weight of a word, of a pair of words and of a Latin token in a Han text, for each field.
FIELDS = {"cat": (3, 0, 0), "sigtitle": (5, 6, 3), "title": (3, 4, 2), "sigdesc": (3, 3, 2), "desc": (1, 1, 1)}


def ranked_segments(items: DataFrame, key: str, column: str, most: int = 12) -> DataFrame:
    """(key, rank, segment): each item's contentful segments, long ones first, of equal signatures one, at most ``most``.

    A text without such segments is one itself, if it says enough as a whole.
    """
    whole = text.collapse_space(F.col(column))
    found = items.select(F.col(key), F.explode(F.filter(text.segments(F.col(column)), text.is_contentful)).alias("segment")).withColumn("norm", text.signature(F.col("segment"))).filter("norm <> ''")
    once = found.groupBy(key, "norm").agg(F.min(F.struct((-F.length("segment")).alias("n"), "segment"))["segment"].alias("segment"))
    w = Window.partitionBy(key).orderBy(F.desc(F.length("segment")), "segment")
    ranked = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(key, "rank", "segment")
    rest = items.join(ranked.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("rank"), whole.alias("segment")).filter(text.is_contentful(F.col("segment")))
    return ranked.unionByName(rest)


def _terms(field: str, value: Column, han: Column) -> Column:
    """The terms of a value with their weights, repeated as often as they occur."""
    word, pair, latin = FIELDS[field]
    made = lambda prefix, terms, weight: F.transform(terms, lambda t: F.struct(F.concat(F.lit(prefix + ":"), t).alias("term"), F.lit(weight).alias("weight")))
    words = text.words(value)
    pairs = F.transform(text.word_pairs(words), lambda t: F.replace(t, F.lit(" "), F.lit("_")))
    plain = made(field, words, word)
    if pair:
        plain = F.concat(plain, made(field + "2", pairs, pair))
    grams = made(field, text.han_grams(value), word)
    if latin:
        grams = F.concat(grams, made(field + "latin", F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9]{3,24})")), latin))
    return F.when(han, grams).otherwise(plain)


def retrieval_terms(values: DataFrame, entity: Sequence[str], han: Column) -> DataFrame:
    """(*entity, term, tf) from (*entity, field, value): sums of the fields' weights over all occurrences of a term.

    English values give words and pairs of words, Han ones runs of two and three Han characters and Latin tokens; ``han``
    says which an entity's values are. Fields are those of ``FIELDS``, others are left out.
    """
    value = text.collapse_space(F.col("value"))
    chosen = F.coalesce(*(F.when(F.col("field") == f, _terms(f, value, han)) for f in FIELDS))
    each = values.select(*entity, F.explode(chosen).alias("t")).select(*entity, "t.term", "t.weight")
    return each.groupBy(*entity, "term").agg(F.sum("weight").cast("bigint").alias("tf"))
