"""Queries that report on sources, labels, slices and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import metrics, profile, queues, rules, split
from pairforge.plans import graph_queries
from pairforge.plans.eval_queries import _SCORED, feature_drift, scored_labels
from pairforge.plans.eval_queries import ORACLE as _EVAL
from pairforge.plans.graph_queries import _components
from pairforge.plans import text_queries
from pairforge.plans.tables import table
from pairforge.sources import checks


def slice_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of three scores by language, by source and over all rows, against that of the plain score on the same slice."""
    own = scored_labels(spark, sf_dir)
    slices = F.array(F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("slice")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("slice")), F.struct(F.lit("all").alias("kind"), F.lit("all").alias("slice")))
    models = F.array(*(F.struct(F.lit(n).alias("model"), c.cast("double").alias("score")) for n, c in (("lower", F.col("score")), ("size", F.col("chars")), ("blanks", -F.col("blanks")))))
    long = own.select("quality", F.explode(slices).alias("s"), "score", "chars", "blanks").select("quality", "s.*", F.explode(models).alias("m")).select("quality", "kind", "slice", "m.*")
    found = metrics.roc_auc(long, ["kind", "slice", "model"], label="quality")
    out = metrics.with_baseline(found, ["kind", "slice"], "model", "auc", "lower")
    return out.withColumn("unstable", F.least("positives", F.col("rows") - F.col("positives")) < 5)


def describe_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


def top_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features that drift most by standardised difference."""
    return metrics.top_by(feature_drift(spark, sf_dir), F.abs("smd"), ["feature", "lang", "scope"], 10).select("place", "feature", "lang", "scope", "smd")


def probability_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's scores: number, range, quartiles, different values to two places, and how many reach a half."""
    own = scored_labels(spark, sf_dir)
    points = metrics.exact_quantiles(own, ["lang"], "score", [0.25, 0.5, 0.75]).groupBy("lang").agg(*(F.round(F.max(F.when(F.col("point") == p, F.col("quantile"))), 6).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))))
    stats = own.groupBy("lang").agg(F.count("*").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), F.count_distinct(F.floor(F.col("score") * 100)).alias("values"), F.count_if(F.col("score") >= 0.5).alias("at_half"))
    return stats.join(points, "lang")


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored_labels(spark, sf_dir)
    n = F.col("doc_id") % 10
    return own.select("doc_id", F.when(n < 6, "train").when(n < 8, "valid").otherwise("test").alias("split"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"), F.when(F.col("score") >= 0.75, "prose").when(F.col("blanks") == 0, "word").otherwise("other").alias("stratum"))


_STRATA = f"""{_SCORED}, st as (select doc_id, case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'valid' else 'test' end as split, case when quality = 1 then 'positive' else 'negative' end as label,
    case when score >= 0.75 then 'prose' when blanks = 0 then 'word' else 'other' end as stratum from s)"""


def label_stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by split, label and stratum, with sums over strata and over labels."""
    return _strata(spark, sf_dir).groupingSets([("split", "label", "stratum"), ("split", "label"), ("split",)], "split", "label", "stratum").agg(F.count("*").alias("n"))


def coverage_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels and strata each split must have and does, as far as the pool has enough, with how bad a lack is."""
    need = spark.createDataFrame([(lab, st, sp, sev, 3) for lab, sev in (("positive", "error"), ("negative", "warning")) for st in ("prose", "word", "other") for sp in ("train", "valid", "test")], "label string, stratum string, split string, severity string, least_in_pool bigint")
    return checks.coverage_by_severity(_strata(spark, sf_dir), need, ["label", "stratum"], "split")


def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of copies among labelled documents: rows, positives, negatives, and counts by label and stratum."""
    members = graph_queries.clone_components(spark, sf_dir)
    own = _strata(spark, sf_dir).join(members, F.col("doc_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "doc_id"))
    return split.component_table(own, "component", "label", "stratum")


def entity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by bucket and reason of exclusion, and the bucket that the counts give the user."""
    events = table(spark, sf_dir, "events")
    v = F.col("value")
    bucket = F.when((F.col("event_type") == "purchase") & (v > 90), "strict").when((F.col("event_type") == "error") & (v > 80), "aux").when(v < 30, "source").otherwise("excluded")
    reason = F.when(bucket == "excluded", F.when(v < 32, "alias").when(v < 34, "key").when(v < 36, "contact").when(v < 38, "script").otherwise("other"))
    return profile.entity_buckets(events.select(F.col("user_id").alias("entity"), bucket.alias("bucket"), reason.alias("reason")), "entity")


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw counts of each source, and what to be warned of."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.count_distinct("text").alias("texts"), F.count_distinct("lang").alias("languages"), F.count_if(F.col("n_chars") < 50).alias("short"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
    )
    said = rules.issues({"blank texts": F.col("blank") == 0, "repeated texts": F.col("texts") + F.col("blank") >= F.col("rows"), "many short texts": F.col("short") * 5 <= F.col("rows"), "few languages": F.col("languages") >= 4})
    return counts.withColumn("warnings", F.array_join(said, "; "))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with a prediction, its margin and the group that they are resampled in: their source, or themselves."""
    own = scored_labels(spark, sf_dir).filter("doc_id % 10 >= 8")
    group = F.coalesce(F.nullif(F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source")), F.lit(" ")), F.concat(F.lit("row-"), F.col("doc_id").cast("string")))
    predicted = (F.col("score") >= 0.7).cast("int")
    return own.select("doc_id", group.alias("group_id"), "quality", "score", predicted.alias("predicted"), (predicted == F.col("quality")).alias("correct"), F.round(F.col("score") - 0.7, 6).alias("margin"))


def bootstrap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold by resamples, and by the rows alone."""
    own = scored_labels(spark, sf_dir)
    found = metrics.bootstrap_threshold(own, "score", "quality", "balanced_accuracy", resamples=200)
    return spark.createDataFrame([(found["threshold"], found["used"], found["reason"], found["distinct"])], "threshold double, used boolean, reason string, distinct int")


def score_bucket_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread documents by their least score over three scorers: high ones, ones near the threshold, and a control group."""
    own = scored_labels(spark, sf_dir)
    share = lambda c: F.round(F.col(c) / F.greatest("chars", F.lit(1)), 6)
    scores = own.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("scorer"), v.alias("score")) for n, v in (("a", F.col("score")), ("b", F.col("score") - share("stops")), ("c", F.col("score") + share("blanks") / 10))))).alias("s")).select("doc_id", "s.*")
    robust = rules.family_scores(scores, "doc_id", {"family": ["a", "b", "c"]})
    read = queues.reviewed_keys([own.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "done").otherwise("pending").alias("review_status"), F.when(F.col("doc_id") % 9 == 0, "positive").otherwise("").alias("review_label"))], "doc_id")
    from pairforge.operators.review import first_bucket

    least, spread = F.col("family_min"), F.round(F.col("family_max") - F.col("family_min"), 6)
    buckets = {"robust_high": least >= 0.75, "boundary": least.between(0.65, 0.75) & (spread >= 0.02), "control": F.col("doc_id") % 7 == 0}
    out = first_bucket(robust.join(read, "doc_id", "left_anti"), buckets, {"robust_high": 15, "boundary": 10, "control": 5}, "doc_id", [F.desc(F.round("family_min", 6))])
    return out.select("doc_id", "bucket", "bucket_rank", F.round("family_min", 6).alias("least"))


QUERIES = {
    f.__name__: f
    for f in (
        slice_deltas, describe_prices, top_drift, probability_stats, label_stratum_counts, coverage_severity, component_labels, entity_buckets, source_audit, prediction_rows, bootstrap_threshold, score_bucket_queue,
    )
}

ORACLE = {
    "slice_deltas": f"""with {_SCORED}, k as (select quality, score, chars, blanks, unnest(['lang', 'source', 'all']) as kind, unnest([lang, source, 'all']) as slice from s),
        l as (select quality, kind, slice, unnest(['lower', 'size', 'blanks']) as model, unnest([score, chars::double, -blanks::double]) as score from k),
        r as (select *, rank() over (partition by kind, slice, model order by score) + (count(*) over (partition by kind, slice, model, score) - 1) / 2.0::double as r from l),
        a as (select kind, slice, model, count(*) as rows, sum(quality)::bigint as positives, case when sum(quality) > 0 and sum(quality) < count(*)
            then round((sum(r) filter (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::double) / (sum(quality) * (count(*) - sum(quality))), 6) end as auc from r group by all)
        select a.*, b.auc as baseline, round(a.auc - b.auc, 6) as delta, least(a.positives, a.rows - a.positives) < 5 as unstable from a join a b on a.kind = b.kind and a.slice = b.slice and b.model = 'lower'""",
    "describe_prices": """select l_returnflag, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(stddev_pop(l_extendedprice), 4) as sd, round(quantile_cont(l_extendedprice, 0.25), 6) as q25,
        round(quantile_cont(l_extendedprice, 0.75), 6) as q75, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem group by 1""",
    "top_drift": f"select row_number() over (order by abs(smd) desc nulls last, feature, lang, scope)::int as place, feature, lang, scope, smd from ({_EVAL['feature_drift']}) order by place limit 10",
    "probability_stats": f"""with {_SCORED} select lang, count(*) as n, min(score) as min, max(score) as max, count(distinct floor(score * 100)) as values, count(*) filter (score >= 0.5) as at_half, round(quantile_cont(score, 0.25), 6) as q25,
        round(quantile_cont(score, 0.5), 6) as median, round(quantile_cont(score, 0.75), 6) as q75 from s group by lang""".replace(" as values", ' as "values"'),
    "label_stratum_counts": f"with {_STRATA} select split, label, stratum, count(*) as n from st group by grouping sets ((split, label, stratum), (split, label), (split))",
    "coverage_severity": f"""with {_STRATA}, q as (select label, stratum, split, severity from (values ('positive', 'error'), ('negative', 'warning')) l(label, severity), (values ('prose'), ('word'), ('other')) t(stratum), (values ('train'), ('valid'), ('test')) p(split)),
        p as (select label, stratum, count(*) as n from st group by all), c as (select label, stratum, split, count(*) as n from st group by all)
        select label, stratum, split, severity, coalesce(p.n, 0) as in_pool, coalesce(c.n, 0) as found, case when coalesce(p.n, 0) < 3 then 'not_required' when coalesce(c.n, 0) > 0 then 'covered' else severity end as status
        from q left join p using (label, stratum) left join c using (label, stratum, split)""",
    "component_labels": f"""with recursive {_STRATA}, sg as (select id, value from {text_queries.SIGNATURES} union all select doc_id, md5(string_split(text, chr(10))[1]) from documents where length(trim(string_split(text, chr(10))[1], ' ')) >= 40),
        ff as (select value, min(id) as a from sg group by value), e as (select distinct a, id as b from sg join ff using (value)), {_components('e')},
        j as (select coalesce(component, doc_id) as component, label, stratum from st left join members on doc_id = id), n as (select component, label || '|' || stratum as k, count(*) as n from j group by all)
        select component, rows, positives, negatives, strata from (select component, count(*) as rows, count(*) filter (label = 'positive') as positives, count(*) filter (label = 'negative') as negatives from j group by component)
        join (select component, string_agg(k || ':' || n, ',' order by k) as strata from n group by component) using (component)""",
    "entity_buckets": """with e as (select user_id as entity, case when event_type = 'purchase' and value > 90 then 'strict' when event_type = 'error' and value > 80 then 'aux' when value < 30 then 'source' else 'excluded' end as bucket, value as v from events),
        r as (select *, case when bucket = 'excluded' then case when v < 32 then 'alias' when v < 34 then 'key' when v < 36 then 'contact' when v < 38 then 'script' else 'other' end end as reason from e),
        c as (select entity, count(*) as items, count(*) filter (bucket = 'source') as source, count(*) filter (bucket = 'strict') as strict, count(*) filter (bucket = 'aux') as aux, count(*) filter (reason = 'alias') as excluded_alias,
            count(*) filter (reason = 'key') as excluded_key, count(*) filter (reason = 'contact') as excluded_contact, count(*) filter (reason = 'script') as excluded_script, count(*) filter (reason = 'other') as excluded_other from r group by entity)
        select *, case when strict > 0 then 'strict' when aux > 0 then 'aux' when source > 0 then 'source' else 'excluded' end as bucket,
            case when strict > 0 or aux > 0 then '' when source > 0 then case when excluded_alias + excluded_key + excluded_contact + excluded_script > 0 then 'partial_item_exclusion' else '' end
            when excluded_alias > 0 then 'alias_overlap' when excluded_key > 0 then 'key_overlap' when excluded_contact > 0 then 'contact_overlap' when excluded_script > 0 then 'no_eligible_items_after_script_filter' else 'no_eligible_items' end as reason from c""",
    "source_audit": """with c as (select source, count(*) as rows, count(*) filter (trim(coalesce(text, ''), ' ') = '') as blank, count(distinct text) as texts, count(distinct lang) as languages, count(*) filter (n_chars < 50) as short,
            min(doc_id) as first_id, max(doc_id) as last_id from documents group by source)
        select *, concat_ws('; ', case when blank > 0 then 'blank texts' end, case when texts + blank < rows then 'repeated texts' end, case when short * 5 > rows then 'many short texts' end, case when languages < 4 then 'few languages' end) as warnings from c""",
    "prediction_rows": f"""with {_SCORED} select doc_id, case when doc_id % 3 = 0 then 'row-' || doc_id else source end as group_id, quality, score, (score >= 0.7)::int as predicted, (score >= 0.7)::int = quality as correct, round(score - 0.7, 6) as margin from s where doc_id % 10 >= 8""",
    "score_bucket_queue": f"""with {_SCORED}, p as (select doc_id, score as a, score - round(stops / greatest(chars, 1), 6) as b, score + round(blanks / greatest(chars, 1), 6) / 10 as c from s where doc_id % 4 <> 0 and doc_id % 9 <> 0),
        f as (select doc_id, least(a, b, c) as lo, round(greatest(a, b, c) - least(a, b, c), 6) as spread from p),
        k as (select *, case when lo >= 0.75 then 'robust_high' when lo between 0.65 and 0.75 and spread >= 0.02 then 'boundary' when doc_id % 7 = 0 then 'control' end as bucket from f),
        r as (select *, row_number() over (partition by bucket order by round(lo, 6) desc, doc_id)::int as bucket_rank from k where bucket is not null)
        select doc_id, bucket, bucket_rank, round(lo, 6) as least from r where bucket_rank <= case bucket when 'robust_high' then 15 when 'boundary' then 10 else 5 end""",
}
