"""Queries over entities and pairs of them: profiles, features, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import numeric
from pairforge.operators import block, features, metrics, profile, ranks
from pairforge.plans.tables import table


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier with lines: counts, statistics and shares."""
    rows = supplier_rows(spark, sf_dir)
    counts = rows.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    brands = counts.groupBy("l_suppkey").agg(F.sum("n").alias("items"), F.count("*").alias("brands"), F.max("n").alias("most"))
    stats = rows.groupBy("l_suppkey").agg(
        profile.number_stats(F.col("l_quantity")).alias("quantity"), F.count_distinct("l_partkey").alias("parts"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.median("l_extendedprice").alias("price"),
    )
    return brands.join(stats, "l_suppkey").select(
        F.col("l_suppkey").alias("supplier"), "items", "brands", "parts", F.col("quantity.min").alias("quantity_min"), F.col("quantity.median").alias("quantity_median"), F.col("quantity.max").alias("quantity_max"),
        numeric.rounded(F.col("price"), 4).alias("price"), numeric.rounded(F.col("discount") / F.col("items") / 100, 6).alias("discount_mean"), numeric.rounded(F.col("most") / F.col("items"), 6).alias("max_brand_share"),
        numeric.rounded(1 - F.col("parts") / F.col("items"), 6).alias("repeated_share"), numeric.rounded(F.col("returned") / F.col("items"), 6).alias("returned_share"),
    )


PROFILES = """r as (select l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag, p_brand from lineitem join part on l_partkey = p_partkey),
b as (select l_suppkey, sum(n)::bigint as items, count(*) as brands, max(n) as most from (select l_suppkey, p_brand, count(*) as n from r group by all) group by l_suppkey),
s as (select l_suppkey, min(l_quantity) as quantity_min, median(l_quantity) as quantity_median, max(l_quantity) as quantity_max, count(distinct l_partkey) as parts,
    sum(round(l_discount * 100)::bigint) as discount, count(*) filter (l_returnflag = 'R') as returned, median(l_extendedprice) as price from r group by l_suppkey),
profiles as (select l_suppkey as supplier, items, brands, parts, quantity_min, quantity_median, quantity_max, round(price, 4) as price, round(discount / items / 100, 6) as discount_mean,
    round(most / items, 6) as max_brand_share, round(1 - parts / items, 6) as repeated_share, round(returned / items, 6) as returned_share from b join s using (l_suppkey))"""


def supplier_price_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's price level among those of its nation, or of its region if the nation has under 4."""
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), "n_nationkey", "n_regionkey")
    own = supplier_profiles(spark, sf_dir).join(nations, "supplier")
    out = features.market_percentile(own, "price", ["n_regionkey"], ["n_nationkey"], "percentile", least=4)
    return out.select("supplier", "n_regionkey", "n_nationkey", "price", "percentile", "percentile_from_market")


def market_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, items and best price by nation and by region at once, as grouping sets."""
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), "n_name", "n_regionkey")
    own = supplier_profiles(spark, sf_dir).join(nations, "supplier")
    return own.groupingSets([("n_regionkey", "n_name"), ("n_regionkey",)], "n_regionkey", "n_name").agg(F.count("*").alias("suppliers"), F.sum("items").alias("items"), F.max("price").alias("price_max"))


#: A value that more suppliers share than this pairs nothing; the keys are so fine that their groups do not grow with the tables.
MOST_SHARED = 50


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of suppliers: of one nation and like balance, or of one lot (part and quantity), with what hit."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 250).alias("level"))
    balance = block.pairs_by_value(suppliers, ["nation", "level"], most=MOST_SHARED).select("left", "right", F.lit("balance").alias("rule"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"))
    lot = block.pairs_by_value(lines, ["part", "quantity"], most=MOST_SHARED).select("left", "right").distinct().select("left", "right", F.lit("lot").alias("rule"))
    return block.rule_hits(balance.unionByName(lot))


SUPPLIER_PAIRS = f"""nv as (select s_suppkey as id, s_nationkey as nation, floor(s_acctbal / 250) as level from supplier), ng as (select nation, level from nv group by all having count(*) between 2 and {MOST_SHARED}),
pv as (select distinct l_suppkey as id, l_partkey as part, l_quantity::int as quantity from lineitem), pg as (select part, quantity from pv group by all having count(*) between 2 and {MOST_SHARED}),
h as (select a.id as "left", b.id as "right", 'balance' as rule from nv a join ng using (nation, level) join nv b using (nation, level) where a.id < b.id
    union select a.id, b.id, 'lot' from pv a join pg using (part, quantity) join pv b using (part, quantity) where a.id < b.id),
pairs as (select "left", "right", list_sort(list(rule)) as rules, count(*)::int as rule_count from h group by all)"""

_USED = ["items", "price", "discount_mean", "max_brand_share", "repeated_share", "returned_share", "brand_set"]


def brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's brands; there are few brands."""
    return supplier_rows(spark, sf_dir).groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("brand_set")).withColumnRenamed("l_suppkey", "supplier")


BRAND_SETS = "brand_sets as (select l_suppkey as supplier, list_sort(list(distinct p_brand)) as brand_set from r group by l_suppkey)"


def supplier_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and support of candidate pairs."""
    both = features.with_both(supplier_pairs(spark, sf_dir), supplier_profiles(spark, sf_dir).join(brand_sets(spark, sf_dir), "supplier"), "supplier", _USED)
    left, right = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))
    style = ["discount_mean", "max_brand_share", "repeated_share", "returned_share"]
    distance = numeric.l1([left(c) for c in style], [right(c) for c in style])
    size, price = numeric.closeness(left("items"), right("items")), numeric.closeness(left("price"), right("price"))
    category = numeric.jaccard(left("brand_set"), right("brand_set"))
    return both.select(
        "left", "right", "rules", "rule_count", numeric.rounded(category, 6).alias("category_jaccard"), numeric.rounded(distance, 6).alias("style_distance"), numeric.rounded(size, 6).alias("size_ratio"), numeric.rounded(price, 6).alias("price_ratio"),
        numeric.rounded(numeric.structural_support(category, distance, size, price), 6).alias("support"), numeric.rounded(features.gap("price"), 4).alias("price_gap"), features.gap("items").alias("items_gap"),
    )


_FEATURES = f"""{BRAND_SETS}, both_sets as (select * from profiles join brand_sets using (supplier)),
f as (select "left", "right", rules, rule_count, abs(x.discount_mean - y.discount_mean) + abs(x.max_brand_share - y.max_brand_share) + abs(x.repeated_share - y.repeated_share) + abs(x.returned_share - y.returned_share) as d,
    least(x.items, y.items) / greatest(x.items, y.items) as sr, least(x.price, y.price) / greatest(x.price, y.price) as pr,
    len(list_intersect(x.brand_set, y.brand_set)) / len(list_distinct(list_concat(x.brand_set, y.brand_set))) as cat,
    abs(x.price - y.price) as pg, abs(x.items - y.items) as ig from pairs join both_sets x on x.supplier = "left" join both_sets y on y.supplier = "right"),
g as (select *, round((cat + greatest(0, 1 - least(d / 2, 1)) + sr + pr) / 4, 6) as support from f)"""


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with score, stratum, priority, and their place in the order of all candidates.

    A pair of one lot counts as one shared title, likeness of price as lexical likeness above a half, every seventh key's
    pairs as sharing a contact.
    """
    from pairforge.operators.review import evidence_stratum

    found = supplier_pair_features(spark, sf_dir)
    titles = F.array_contains("rules", "lot").cast("int")
    lexical = F.when(F.col("price_ratio") >= 0.5, numeric.rounded(F.col("price_ratio") - 0.5, 6)).otherwise(0.0)
    contacts, none = ((F.col("left") + F.col("right")) % 7 == 0).cast("int"), F.lit(0)
    scored = found.withColumns({"titles": titles, "lexical": lexical, "contacts": contacts}).withColumns({
        "score": numeric.rounded(numeric.rank_score(F.col("contacts"), none, none, F.col("titles"), F.col("lexical"), F.col("support"), F.lit(False)), 6),
        "stratum": evidence_stratum(F.lit(False), F.col("contacts"), none, F.col("titles"), none, F.col("lexical"), F.col("support")),
        "priority": numeric.review_priority(F.col("contacts"), none, none, F.col("titles"), F.col("lexical"), F.col("support")),
    })
    order = F.element_at(F.create_map(*(F.lit(x) for p in (("high", 0), ("medium", 1), ("low", 2)) for x in p)), F.col("priority"))
    keyed = scored.withColumn("_order", order)
    ranked = ranks.global_rank(keyed, [F.col("_order"), F.desc("score"), F.desc("rule_count"), F.col("left"), F.col("right")])
    return ranked.select("left", "right", "score", "stratum", "priority", "rank")


def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders by segment: how many, in all, median, exclusive 90 % point, those of 2 and of 15 or more."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    own = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    # counts of counts: an array of distinct numbers with their times would do at any size; a segment's exact point comes from ranks
    from pyspark.sql import Window

    sizes = own.groupBy("c_mktsegment", "n").agg(F.count("*").alias("times"))
    up = Window.partitionBy("c_mktsegment").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("upto", F.sum("times").over(up)).withColumn("all", F.sum("times").over(Window.partitionBy("c_mktsegment")))
    place = F.least(F.greatest(F.floor((F.col("all") + 1) * 9 / 10), F.lit(1)), F.col("all") - 1)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("n")))
    point = F.when(F.first("all") < 10, F.max("n")).otherwise((at(place) * (10 - F.first((F.col("all") + 1) * 9 % 10)) + at(place + 1) * F.first((F.col("all") + 1) * 9 % 10)) / 10)
    middle = (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor((F.col("all") + 2) / 2))) / 2
    return ranked.groupBy("c_mktsegment").agg(
        F.sum("times").alias("customers"), F.sum(F.col("n") * F.col("times")).alias("orders"), middle.alias("median"), F.round(point, 6).alias("p90"),
        F.sum(F.when(F.col("n") >= 2, F.col("times")).otherwise(0)).alias("at_least_2"), F.sum(F.when(F.col("n") >= 15, F.col("times")).otherwise(0)).alias("at_least_15"),
    )


def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by kind, and the kind that decides its bucket."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("high"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.min("event_id").alias("first_id")
    )
    bucket = F.when(F.col("purchases") > F.col("clicks"), "buyer").when(F.col("high") * 2 > F.col("n"), "high").when(F.col("n") < 5, "few").otherwise("other")
    return counts.withColumn("bucket", bucket)


def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rate = lambda c: F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"{c}_missing")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), *map(rate, ("text", "source", "quality", "toxic")))


def json_path_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return events.groupBy("event_type").agg(F.count("k").alias("present"), F.sum("k").alias("total"), F.max("k").alias("most"), F.count_if(F.get_json_object("props", "$.no.such").isNull()).alias("absent"))


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by flag and status: number, least, exact quantiles, greatest; without a group's values in one place."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    by = ["l_returnflag", "l_linestatus"]
    names = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    found = metrics.exact_quantiles(lines, by, "l_extendedprice", list(names.values()))
    wide = found.groupBy(*by).agg(*(F.round(F.max(F.when(F.col("point") == p, F.col("quantile"))), 6).alias(n) for n, p in names.items()))
    ends = lines.groupBy(*by).agg(F.count("l_extendedprice").alias("n"), F.min("l_extendedprice").alias("min"), F.max("l_extendedprice").alias("max"))
    return ends.join(wide, by).select(*by, "n", "min", *names, "max")


def customer_orders_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two endpoint lookups and an aggregate: revenue by customer nation and supplier nation, in cents."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint").alias("cents"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("left")), F.col("o_custkey") == F.col("c_custkey"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("right"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("left", "right").agg(F.sum("cents").alias("cents"), F.count("*").alias("lines"))


QUERIES = {
    "supplier_profile_stats": supplier_profiles,
    **{
        f.__name__: f
        for f in (
            supplier_price_percentile, market_rollup, supplier_pair_features, candidate_rank, activity_summary, conditional_counts, missing_rates, json_path_agg, score_distribution, customer_orders_revenue,
        )
    },
}

ORACLE = {
    "supplier_profile_stats": f"with {PROFILES} select * from profiles",
    "supplier_price_percentile": f"""with {PROFILES}, o as (select supplier, n_regionkey, n_nationkey, price from profiles join supplier on supplier = s_suppkey join nation on s_nationkey = n_nationkey),
        c as (select *, count(price) over (partition by n_nationkey) as nm, count(price) over (partition by n_nationkey order by price range unbounded preceding) as lm,
            count(price) over (partition by n_regionkey) as np, count(price) over (partition by n_regionkey order by price range unbounded preceding) as lp from o)
        select supplier, n_regionkey, n_nationkey, price, case when nm >= 4 then round((lm - 1) / (nm - 1), 6) when np = 1 then 0.5 else round((lp - 1) / (np - 1), 6) end as percentile, nm >= 4 as percentile_from_market from c""",
    "market_rollup": f"""with {PROFILES} select n_regionkey, n_name, count(*) as suppliers, sum(items)::bigint as items, max(price) as price_max
        from profiles join supplier on supplier = s_suppkey join nation on s_nationkey = n_nationkey group by grouping sets ((n_regionkey, n_name), (n_regionkey))""",
    "supplier_pair_features": f"""with {PROFILES}, {SUPPLIER_PAIRS}, {_FEATURES}
        select "left", "right", rules, rule_count, round(cat, 6) as category_jaccard, round(d, 6) as style_distance, round(sr, 6) as size_ratio, round(pr, 6) as price_ratio, support, round(pg, 4) as price_gap, ig as items_gap from g""",
    "candidate_rank": f"""with {PROFILES}, {SUPPLIER_PAIRS}, {_FEATURES},
        k as (select "left", "right", rule_count, support, list_contains(rules, 'lot')::int as t, ("left" + "right") % 7 = 0 as c, case when round(pr, 6) >= 0.5 then round(round(pr, 6) - 0.5, 6) else 0 end as lex from g),
        z as (select *, round(case when c then 6 else 0 end + 2 * t + 6 * lex + 2 * support, 6) as score,
            case when c and t > 0 then 'identifier_plus_text' when t > 0 then 'text_clone_primary' when c then 'identifier_primary' when lex > 0 and support >= 0.5 then 'semantic_structural' else 'semantic_only' end as stratum,
            case when c then 'high' when t > 0 and (lex >= 0.16 or support >= 0.6) then 'high' when lex >= 0.22 or t > 0 and support >= 0.5 then 'medium' else 'low' end as priority from k)
        select "left", "right", score, stratum, priority, row_number() over (order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, score desc, rule_count desc, "left", "right") as rank from z""",
    "activity_summary": """with o as (select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by c_mktsegment, c_custkey),
        l as (select c_mktsegment, list_sort(list(n)) as s, count(*) as c from o group by all), j as (select *, least(greatest((c + 1) * 9 // 10, 1), c - 1) as j, (c + 1) * 9 % 10 as d from l)
        select c_mktsegment, c as customers, list_sum(s)::bigint as orders, list_median(s)::double as median, round(case when c < 10 then s[c] else (s[j] * (10 - d) + s[j + 1] * d) / 10 end, 6) as p90,
            len(list_filter(s, lambda x: x >= 2))::bigint as at_least_2, len(list_filter(s, lambda x: x >= 15))::bigint as at_least_15 from j""",
    "conditional_counts": """with c as (select user_id, count(*) as n, count(*) filter (value >= 50) as high, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'purchase') as purchases, min(event_id) as first_id from events group by user_id)
        select *, case when purchases > clicks then 'buyer' when high * 2 > n then 'high' when n < 5 then 'few' else 'other' end as bucket from c""",
    "missing_rates": """select lang, count(*) as n, round(avg((text is null)::int), 6) as text_missing, round(avg((source is null)::int), 6) as source_missing, round(avg((quality is null)::int), 6) as quality_missing,
        round(avg((toxic is null)::int), 6) as toxic_missing from documents left join labels using (doc_id) group by lang""",
    "json_path_agg": """with e as (select event_type, props, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)
        select event_type, count(k) as present, sum(k)::bigint as total, max(k) as most, count(*) filter (json_extract_string(props, '$.no.such') is null) as absent from e group by event_type""",
    "score_distribution": """select l_returnflag, l_linestatus, count(l_extendedprice) as n, min(l_extendedprice) as min, round(quantile_cont(l_extendedprice, 0.05), 6) as p05, round(quantile_cont(l_extendedprice, 0.25), 6) as p25,
        round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as p75, round(quantile_cont(l_extendedprice, 0.95), 6) as p95, max(l_extendedprice) as max from lineitem group by all""",
    "customer_orders_revenue": """select c_nationkey as "left", s_nationkey as "right", sum(round(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint as cents, count(*) as lines
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all""",
}
