"""Queries of configured filters, decisions and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import graph, rules
from pairforge.plans.entity_queries import PROFILES, supplier_profiles
from pairforge.plans.eval_queries import _SCORED, scored_labels
from pairforge.plans.graph_queries import _components
from pairforge.plans.tables import table
from pairforge.sources import checks


def configured_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"brands": {"min": 2}, "returned_share": {"above": 0.2, "max": 0.4}, "price": {"present": True}}
    return supplier_profiles(spark, sf_dir).filter(rules.condition(config)).select("supplier", "brands", "returned_share")


def rule_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents read by rules in order: label, reason and the rule's place."""
    own = scored_labels(spark, sf_dir)
    listed = [(F.col("toxic") == 1, "negative", "toxic"), (F.col("stops") * 200 < F.col("chars"), "uncertain", "few stops"), (F.col("score") >= 0.75, "positive", "prose"), (F.col("blanks") == 0, "negative", "one word")]
    return own.select("doc_id", rules.decided(listed, ("uncertain", "no rule")).alias("d")).select("doc_id", "d.label", "d.reason", "d.rule")


def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each labelled document's row, as a list joined by |, and how often."""
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id", "left")
    found = rules.issues({"no_text": F.length("text") > 0, "odd_source": F.col("source").rlike("^src[0-9]$"), "long": F.col("n_chars") <= 4000, "label": F.col("quality").isin(0, 1)})
    return own.select(F.array_join(found, "|").alias("issues")).groupBy("issues").agg(F.count("*").alias("n"))


def split_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by split and language, checked against what each must have."""
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "valid").otherwise("test")
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("split", split)
    counts = own.groupBy("split", "lang").agg(F.count("*").alias("n"))
    need = spark.createDataFrame([(s, lang, n) for s, n in (("train", 20), ("valid", 5), ("test", 8)) for lang in ("en", "de", "xx")], "split string, lang string, least bigint")
    return checks.coverage(counts, need, ["split", "lang"])


def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by the orders and by their lines."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = checks.reconciled(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), lines.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n")
    return out.groupBy("agrees").agg(F.count("*").alias("customers"), F.sum("expected").alias("expected"), F.sum("observed").alias("observed"))


def run_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score's mean by language over five folds as runs: runs, mean, least and greatest."""
    own = scored_labels(spark, sf_dir).groupBy("lang", (F.col("doc_id") % 5).alias("fold")).agg(F.round(F.avg("score"), 6).alias("m"))
    return rules.run_summary(own, ["lang"], "m")


def family_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored_labels(spark, sf_dir)
    share = lambda c: F.round(F.col(c) / F.greatest("chars", F.lit(1)), 6)
    long = own.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("scorer"), v.alias("score")) for n, v in (("lower", F.col("score")), ("stops", share("stops")), ("blanks", share("blanks")))))).alias("s")).select("doc_id", "s.*")
    return rules.family_scores(long, "doc_id", {"letters": ["lower"], "marks": ["stops", "blanks"]})


def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers joined by nation and level of balance, and by equal cents of it: components over both kinds of alias edges."""
    own = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.concat_ws("-", F.lit("n"), F.col("s_nationkey"), F.floor(F.col("s_acctbal") / 500)).alias("level"), F.concat_ws("-", F.lit("c"), F.round(F.col("s_acctbal") * 100).cast("bigint") % 1000).alias("cents")
    )
    return graph.connected_components(rules.alias_edges(own, "k", "level").unionByName(rules.alias_edges(own, "k", "cents")))


QUERIES = {f.__name__: f for f in (configured_filter, rule_review, review_issues, split_label_counts, count_reconciliation, run_metrics_summary, family_score_summary, alias_components)}

ORACLE = {
    "configured_filter": f"with {PROFILES} select supplier, brands, returned_share from profiles where brands >= 2 and returned_share > 0.2 and returned_share <= 0.4 and price is not null",
    "rule_review": f"""with {_SCORED} select doc_id, case when toxic = 1 then 'negative' when stops * 200 < chars then 'uncertain' when score >= 0.75 then 'positive' when blanks = 0 then 'negative' else 'uncertain' end as label,
        case when toxic = 1 then 'toxic' when stops * 200 < chars then 'few stops' when score >= 0.75 then 'prose' when blanks = 0 then 'one word' else 'no rule' end as reason,
        case when toxic = 1 then 1 when stops * 200 < chars then 2 when score >= 0.75 then 3 when blanks = 0 then 4 else 0 end as rule from s""",
    "review_issues": """select concat_ws('|', case when not coalesce(length(text) > 0, false) then 'no_text' end, case when not coalesce(regexp_matches(source, '^src[0-9]$'), false) then 'odd_source' end,
        case when not coalesce(n_chars <= 4000, false) then 'long' end, case when not coalesce(quality in (0, 1), false) then 'label' end) as issues, count(*) as n from labels left join documents using (doc_id) group by 1""",
    "split_label_counts": """with c as (select case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'valid' else 'test' end as split, lang, count(*) as n from labels join documents using (doc_id) group by all),
        r as (select split, lang, least from (values ('train', 20), ('valid', 5), ('test', 8)) s(split, least), (values ('en'), ('de'), ('xx')) l(lang))
        select split, lang, least::bigint as least, coalesce(n, 0) as found, coalesce(n, 0) >= least as enough from r left join c using (split, lang)""",
    "count_reconciliation": """with o as (select o_custkey, count(*) as e from orders group by 1), l as (select o_custkey, count(*) as b from (select distinct l_orderkey from lineitem) join orders on l_orderkey = o_orderkey group by 1)
        select coalesce(e, 0) = coalesce(b, 0) as agrees, count(*) as customers, sum(coalesce(e, 0))::bigint as expected, sum(coalesce(b, 0))::bigint as observed from o full join l using (o_custkey) group by 1""",
    "run_metrics_summary": f"""with {_SCORED}, f as (select lang, doc_id % 5 as fold, round(avg(score), 6) as m from s group by all)
        select lang, count(*) as runs, round(avg(m), 6) as mean, min(m) as least, max(m) as greatest from f group by lang""",
    "family_score_summary": f"""with {_SCORED}, p as (select doc_id, score, round(stops / greatest(chars, 1), 6) as a, round(blanks / greatest(chars, 1), 6) as b from s)
        select doc_id, score as letters_min, round(score, 9) as letters_mean, score as letters_max, least(a, b) as marks_min, round((a + b) / 2, 9) as marks_mean, greatest(a, b) as marks_max from p""",
    "alias_components": f"""with recursive n as (select s_suppkey as k, concat_ws('-', 'n', s_nationkey, floor(s_acctbal / 500)::bigint) as v from supplier union all select s_suppkey, concat_ws('-', 'c', round(s_acctbal * 100)::bigint % 1000) from supplier),
        m as (select v, min(k) as a from n group by v), h as (select distinct a, k as b from n join m using (v) where a <> k), {_components('h')} select * from members""",
}
