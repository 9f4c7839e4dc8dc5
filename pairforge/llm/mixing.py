"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the mixture's mass over its own mass. A document's
number of copies is a Poisson draw with that mean, by inverting the distribution at a number that a hash of the seed
and doc_id gives; copies are exploded and the whole mixture is put in the order of another hash. Only DataFrame
functions run.

Defined cases: a null source is a source of its own; null and empty texts have no mass and copy like any other row
of their source; a source without mass counts as having mass 1; rows that repeat a doc_id draw alike, and null ids
count as one id; sources that explicit weights don't name get the rate 0. An empty table gives an empty mixture.
Columns of the input named like the added ones (copy, copies, place) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A draw adds up parts of at most this mean, so that exp(-mean) is far from underflow.
PART = 16
#: Terms of a part's distribution; at this mean what lies beyond is below 1e-40.
TERMS = 100
#: Rates of at most this number of sources are broadcast, otherwise they are joined by salted keys.
MOST_BROADCAST = 10_000
SALTS = 64


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts, with 52 bits."""
    text = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, *, source: str, text: str, exponent: float) -> DataFrame:
    """Each source's mean repetition rate: (source, rate). ``weights`` need not add up to 1.

    Without weights a source's share is its mass (characters of text) to the power ``exponent``. The mixture's mass
    is that of all documents.
    """
    mass = docs.groupBy(F.col(source).alias("source")).agg(F.greatest(F.sum(F.coalesce(F.length(text), F.lit(0))), F.lit(1)).cast("double").alias("mass"))
    if weights is None:
        share = F.pow("mass", F.lit(exponent))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    own = mass.withColumn("share", share)
    total = own.agg(F.sum("mass").alias("all_mass"), F.sum("share").alias("all_share"))
    # one row beside every source: a join of an aggregate without keys
    rate = F.when(F.col("all_share") > 0, F.col("share") * F.col("all_mass") / (F.col("all_share") * F.col("mass"))).otherwise(0.0)
    return own.join(F.broadcast(total), F.lit(True)).select("source", rate.alias("rate"))


def _distribution(rates: DataFrame) -> DataFrame:
    """Adds ``parts``, the number of draws that are added up, and ``below``: P(X <= k) of one draw for each k."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("below"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["below"], F.array(F.element_at(acc["below"], -1) + p)).alias("below"))

    return table.select("source", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step)["below"].alias("below"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, seed: int = 20, exponent: float = 0.5, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixture: the columns of ``docs`` with copy (1 to copies), copies, and place, whose order is the mixture's.

    Partitions hold successive ranges of ``place``, sorted. The rates are one row for each source; their number is
    checked, and beyond the bound they are joined by salted keys instead of a broadcast.
    """
    table = docs.drop("copy", "copies", "place")
    rates = _distribution(source_rates(table, weights, source=source, text=text, exponent=exponent))
    spark = docs.sparkSession
    few = rates.limit(MOST_BROADCAST + 1).collect()
    names = {"source": "_mix_source", "parts": "_mix_parts", "below": "_mix_below"}
    if len(few) <= MOST_BROADCAST:
        own = F.broadcast(spark.createDataFrame(few, rates.schema).withColumnsRenamed(names))
        joined = table.join(own, F.col(source).eqNullSafe(F.col("_mix_source")))
    else:
        own = rates.withColumnsRenamed(names).withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")
        joined = table.join(own, F.col(source).eqNullSafe(F.col("_mix_source")) & (salt == F.col("_mix_salt"))).drop("_mix_salt")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), lambda j: uniform(seed, key, j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("_mix_below"), lambda c: c <= u)))
    counted = joined.withColumn("copies", copies).drop(*names.values()).filter("copies > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.withColumn("place", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint"))
    # as many ranges as the session asks for, more if the input has more parts: a range does not grow with the input
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return out.repartitionById(n, (F.col("place") / float(1 << 60) * n).cast("int")).sortWithinPartitions("place", doc_id, "copy")


def oracle(seed: int = 20, exponent: float = 0.5) -> str:
    """The mixture of ``documents`` in DuckDB's SQL."""
    return f"""
    with m as (select source, greatest(sum(coalesce(length(text), 0)), 1)::double as mass from documents group by source),
    r as (select source, pow(mass, {exponent}) * (select sum(mass) from m) / ((select sum(pow(mass, {exponent})) from m) * mass) as rate from m),
    p as (select source, greatest(ceil(rate / {PART}), 1)::int as parts, rate / greatest(ceil(rate / {PART}), 1) as mean from r),
    c as (select source, parts, list(b order by k) as below from (
        select source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) as b
        from p, (select unnest(generate_series(0, {TERMS})) as k)) group by source, parts),
    d as (select documents.*, list_sum(list_transform(generate_series(1, parts), lambda j: len(list_filter(below, lambda x:
            x <= ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null') || ':' || j::varchar), 1, 13))::bigint / 4503599627370496.0))))::int as copies
        from documents join c on documents.source is not distinct from c.source),
    e as (select *, unnest(generate_series(1, copies))::int as copy from d where copies > 0)
    select *, ('0x' || substr(md5('{seed}-order:' || coalesce(doc_id::varchar, 'null') || ':' || copy::varchar), 1, 15))::bigint as place from e
    """
