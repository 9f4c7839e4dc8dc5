"""Queries that evaluate scores, compare groups, sample and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import metrics, ml, review, split
from pairforge.plans.tables import table


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a plain score: the share of lower-case letters, in thousandths of one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("chars"), F.regexp_count("text", F.lit("[a-z]")).alias("lower"), F.regexp_count("text", F.lit("[.,!?]")).alias("stops"), F.regexp_count("text", F.lit(" ")).alias("blanks"))
    own = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return own.withColumn("score", F.floor(F.col("lower") * 1000 / F.greatest("chars", F.lit(1))) / 1000)


_SCORED = """x as (select doc_id, lang, source, quality, toxic, length(text) as chars, len(regexp_extract_all(text, '[a-z]')) as lower, len(regexp_extract_all(text, '[.,!?]')) as stops, len(regexp_extract_all(text, ' ')) as blanks
    from documents join labels using (doc_id)), s as (select *, floor(lower * 1000 / greatest(chars, 1)) / 1000 as score from x)"""


def roc_auc_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the score for quality, by language and for all, with a mark for slices of few of either label."""
    own = scored_labels(spark, sf_dir)
    slices = own.select(F.explode(F.array(F.col("lang"), F.lit("all"))).alias("slice"), "score", "quality")
    out = metrics.roc_auc(slices, ["slice"], label="quality")
    return out.withColumn("unstable", F.least("positives", F.col("rows") - F.col("positives")) < 5)


def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored_labels(spark, sf_dir), ["lang"], "score", "quality", "doc_id")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored_labels(spark, sf_dir), ["lang"], F.col("score") >= 0.7, F.col("quality"))


def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = metrics.threshold_scan(scored_labels(spark, sf_dir), "score", "quality")
    return scan.withColumn("threshold", F.round("threshold", 6))


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the best balanced accuracy, and the one chosen by a guard that wants many negative answers."""
    scan = metrics.threshold_scan(scored_labels(spark, sf_dir), "score", "quality")
    made = lambda name, row: row.select(F.lit(name).alias("choice"), F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn", F.round("metric", 6).alias("metric"))
    plain = metrics.best_threshold(scan, "balanced_accuracy")
    guarded = metrics.best_threshold(scan, "accuracy", least_positive=5, least_negative=60, most_drop=0.125)
    return made("plain", plain).unionByName(made("guarded", guarded))


def probability_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored_labels(spark, sf_dir)
    y = F.col("quality").cast("double")
    return own.groupBy("lang").agg(F.round(metrics.log_loss(F.col("score"), y), 6).alias("log_loss"), F.round(metrics.brier(F.col("score"), y), 6).alias("brier"))


def seed_mean_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three scores of each labelled document, those with all three and those with any."""
    own = scored_labels(spark, sf_dir)
    one = own.select("doc_id", "score")
    two = own.filter("doc_id % 3 <> 0").select("doc_id", (F.col("blanks") / F.greatest("chars", F.lit(1))).alias("score"))
    three = own.select("doc_id", (F.col("stops") / F.greatest("chars", F.lit(1))).alias("score"))
    every = metrics.ensemble([one, two, three], "doc_id", need_all=False)
    return every.select("doc_id", F.round("mean_score", 6).alias("mean_score"), "members", (F.col("members") == 3).alias("complete"))


_SIZES = ["chars", "lower", "stops", "blanks"]


def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language against English, for all labels and by label: means, deviations and standardised differences."""
    own = scored_labels(spark, sf_dir)
    long = own.select("lang", F.col("quality").cast("string").alias("label"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in _SIZES))).alias("f")).select("lang", "label", "f.feature", "f.v")
    sums = long.groupingSets([("feature", "lang"), ("feature", "lang", "label")], "feature", "lang", "label").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    scope = sums.withColumn("scope", F.coalesce("label", F.lit("all")))
    base = scope.filter("lang = 'en'").select("feature", "scope", F.col("m").alias("m0"), F.col("s2").alias("v0"))
    both = scope.filter("lang <> 'en'").join(base, ["feature", "scope"])
    return both.select("feature", "lang", "scope", "n", F.round("m", 6).alias("mean"), F.round(F.sqrt("s2"), 6).alias("sd"), F.round(metrics.mean_difference(F.col("m"), F.col("s2"), F.col("m0"), F.col("v0")), 6).alias("smd"))


def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the distributions of values of the first and the second half of each type's events by id."""
    events = table(spark, sf_dir, "events")
    mid = events.groupBy("event_type").agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("mid"))
    return metrics.ks_statistic(events.join(F.broadcast(mid), "event_type"), "value", F.col("event_id") > F.col("mid"), ["event_type"])


def high_sim_negative_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each other language's low-quality documents that score above the 90 % point of the English good ones."""
    own = scored_labels(spark, sf_dir)
    point = metrics.exact_quantiles(own.filter("lang = 'en' and quality = 1"), [], "score", [0.9]).select(F.col("quantile").alias("q90"))
    return own.filter("quality = 0").join(F.broadcast(point), F.lit(True)).groupBy("lang").agg(F.count("*").alias("negatives"), F.count_if(F.col("score") >= F.col("q90")).alias("high"), F.round(F.first("q90"), 6).alias("q90"))


def balanced_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    out = review.balanced_queue(docs, "lang", [F.desc("n_chars"), F.col("doc_id")], ["fr", "de", "es", "en"])
    return out.select("doc_id", "lang", "turn", F.col("queue_rank").cast("bigint").alias("queue_rank"))


def anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label covers, by source, with the number of those that one does."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    open_ = docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("pending"))
    done = docs.join(labels, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("covered"))
    return open_.join(done, "source", "full").select("source", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("covered", F.lit(0)).alias("covered"))


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    queue = labels.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality").cast("string")).alias("label"), F.lit("old").alias("note"))
    new = labels.filter("doc_id % 4 <> 1").select("doc_id", F.col("toxic").cast("string").alias("label"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.lit("new")).alias("note"))
    return queue, new


def upsert_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert(*_reviews(spark, sf_dir), "doc_id", ["label", "note"], "label")


def skip_missing_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert(*_reviews(spark, sf_dir), "doc_id", ["label", "note"], "label", missing="skip", overwrite=True)


def bucket_override_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    defaults = spark.createDataFrame([("en", "keep"), ("de", "drop")], "lang string, decision string")
    own = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("recheck").alias("decision"))
    return review.overridden(docs, defaults, own, "lang", "doc_id", "decision").select("doc_id", "lang", "decision", "decided_by")


def head_tail_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return review.head_and_tail(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], [F.asc("o_totalprice"), F.desc("o_orderkey")], 25, 10)


def bucketed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the first of three buckets that takes them, the best 30 of each."""
    own = scored_labels(spark, sf_dir)
    buckets = {"toxic": F.col("toxic") == 1, "low": F.col("quality") == 0, "border": F.col("score").between(0.7, 0.8)}
    return review.first_bucket(own, buckets, {"toxic": 30, "low": 30, "border": 30}, "doc_id", [F.desc("score")]).select("doc_id", "bucket", "bucket_rank", "score")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return split.stratified_sample(own, ["lang", "quality"], "doc_id", 0.2, least=2, order=F.col("doc_id")).select("doc_id", "lang", "quality")


def hard_boundary_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored_labels(spark, sf_dir).select("doc_id", "score", "quality")
    return split.hard_boundary_sample(own, "score", "quality", "doc_id", 0.5, order=F.col("doc_id"))


def _fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored_labels(spark, sf_dir)
    share = lambda c: (F.col(c) / F.greatest("chars", F.lit(1))).alias(f"{c}_share")
    return own.select("doc_id", "lang", "quality", F.log1p("chars").alias("size"), share("lower"), share("stops"), share("blanks"))


_FITTED = ["size", "lower_share", "stops_share", "blanks_share"]


def logistic_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a balanced logistic scorer, fitted by Newton's method on all labelled documents."""
    rows = ml.balanced_weights(_fitting(spark, sf_dir), "quality").cache()
    model = ml.fit_logistic(rows, _FITTED, "quality", weight="weight")
    return rows.select("doc_id", "quality", F.round(model.probability(), 5).alias("prob_positive"), (model.probability() >= 0.5).cast("int").alias("pred_positive"))


def fixed_logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a stored scorer."""
    model = ml.Scorer(["chars", "stops"], [1000.0, 40.0], [500.0, 20.0], 0.25, [0.5, -0.75])
    return scored_labels(spark, sf_dir).select("doc_id", F.round(model.probability(), 6).alias("prob_positive"))


def platt_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain score calibrated to quality."""
    own = scored_labels(spark, sf_dir).select("doc_id", "quality", "score").cache()
    fitted = ml.fit_platt(own, "score", "quality")
    return own.select("doc_id", F.round(fitted.apply(F.col("score")), 5).alias("calibrated"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the score for quality over 5,000 resamples of sources, with its interval."""
    own = scored_labels(spark, sf_dir)
    return metrics.interval(metrics.bootstrap(own, "source", "score", "quality", resamples=5000, seed=20260513), "auc")


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference in AUC of two scores over the same resamples of sources."""
    own = scored_labels(spark, sf_dir).withColumn("other", F.col("chars").cast("double"))
    draw = lambda s: metrics.bootstrap(own, "source", s, "quality", resamples=5000, seed=20260513)
    return metrics.paired_difference(draw("score"), draw("other"))


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several scores by language as model families: AUC first, then rows."""
    own = scored_labels(spark, sf_dir)
    long = own.select("lang", "quality", F.explode(F.array(*(F.struct(F.lit(n).alias("model_id"), c.cast("double").alias("score")) for n, c in (("lower", F.col("score")), ("size", F.col("chars")), ("blanks", -F.col("blanks")))))).alias("m")).select(F.col("lang").alias("family"), "quality", "m.model_id", "m.score")
    return ml.best_model(metrics.roc_auc(long, ["family", "model_id"], label="quality"), [("auc", True), ("rows", True)])


QUERIES = {
    f.__name__: f
    for f in (
        roc_auc_by_slice, avg_precision, confusion_metrics, threshold_scan, threshold_choice, probability_losses, seed_mean_ensemble, feature_drift, ks_drift, high_sim_negative_ratio, balanced_review_queue,
        anti_join_pending, upsert_reviews, skip_missing_reviews, bucket_override_decisions, head_tail_select, bucketed_queue, stratified_sample, hard_boundary_sample, logistic_fit_score, fixed_logistic_score,
        platt_calibrate, bootstrap_ci, paired_bootstrap, model_choice,
    )
}

_SCAN = f"""{_SCORED}, p as (select score as t from s group by score), g as (select t from p union select (t + lead(t) over (order by t)) / 2 from p union select 0.05 union select 0.95),
c as (select t, count(*) filter (quality = 1 and score >= t) as tp, count(*) filter (quality = 0 and score >= t) as fp, count(*) filter (quality = 0 and score < t) as tn, count(*) filter (quality = 1 and score < t) as fn
    from (select t from g where t is not null), s group by t)"""

_UPSERT = """q as (select doc_id, case when doc_id % 2 = 0 then quality::varchar end as label, 'old' as note from labels where doc_id % 3 <> 0),
n as (select doc_id, toxic::varchar as label, case when doc_id % 5 = 0 then '' else 'new' end as note from labels where doc_id % 4 <> 1)"""

ORACLE = {
    "roc_auc_by_slice": f"""with {_SCORED}, l as (select lang as slice, score, quality from s union all select 'all', score, quality from s),
        r as (select *, rank() over (partition by slice order by score) + (count(*) over (partition by slice, score) - 1) / 2.0::double as r from l)
        select slice, count(*) as rows, sum(quality)::bigint as positives, case when sum(quality) > 0 and sum(quality) < count(*) then round((sum(r) filter (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::double) / (sum(quality) * (count(*) - sum(quality))), 6) end as auc,
            least(sum(quality), count(*) - sum(quality)) < 5 as unstable from r group by slice""",
    "avg_precision": f"""with {_SCORED}, w as (select lang, quality, sum(quality) over o as tp, count(*) over o as k from s window o as (partition by lang order by score desc, doc_id rows unbounded preceding))
        select lang, count(*) as rows, case when sum(quality) > 0 then round(sum(tp / k) filter (quality = 1) / sum(quality), 6) end as average_precision from w group by lang""",
    "confusion_metrics": f"""with {_SCORED}, c as (select lang, count(*) filter (score >= 0.7 and quality = 1) as tp, count(*) filter (score >= 0.7 and quality = 0) as fp, count(*) filter (score < 0.7 and quality = 0) as tn, count(*) filter (score < 0.7 and quality = 1) as fn from s group by lang)
        select lang, tp, fp, tn, fn, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) as recall, coalesce(round(tn / nullif(tn + fp, 0), 6), 0) as specificity,
            round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) as balanced_accuracy, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) as f1, coalesce(round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6), 0) as accuracy from c""",
    "threshold_scan": f"with {_SCAN} select round(t, 6) as threshold, tp, fp, tn, fn from c",
    "threshold_choice": f"""with {_SCAN}, r as (select *, coalesce(round(tp / nullif(tp + fp, 0), 9), 0) as pr, coalesce(round(tp / nullif(tp + fn, 0), 9), 0) as re, coalesce(round(tn / nullif(tn + fp, 0), 9), 0) as sp,
            coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) as f1, coalesce(round((tp + tn) / nullif(tp + fp + tn + fn, 0), 9), 0) as ac from c), m as (select *, round((re + sp) / 2, 9) as ba from r),
        plain as (select * from m order by ba desc, sp desc, pr desc, f1 desc, t desc limit 1), a as (select *, tp + fp >= 5 and tn + fn >= 60 as ok from m order by ac desc, sp desc, pr desc, f1 desc, t desc limit 1),
        guarded as (select * from m where tp + fp >= 5 and tn + fn >= 60 and (select max(ac) from m) - ac <= 0.125 + 1e-12 order by ac desc, f1 desc, re desc, pr desc, sp desc, t limit 1),
        z as (select 'plain' as choice, t, tp, fp, tn, fn, ba as metric from plain
            union all select 'guarded', t, tp, fp, tn, fn, ac from a where ok or not exists (select 1 from guarded) union all select 'guarded', t, tp, fp, tn, fn, ac from guarded where not (select ok from a))
        select choice, round(t, 6) as threshold, tp, fp, tn, fn, round(metric, 6) as metric from z""",
    "probability_losses": f"""with {_SCORED}, p as (select *, greatest(least(score, 1 - 1e-9), 1e-9) as q from s)
        select lang, round(avg(-(quality * ln(q) + (1 - quality) * ln(1 - q))), 6) as log_loss, round(avg((score - quality) * (score - quality)), 6) as brier from p group by lang""",
    "seed_mean_ensemble": f"""with {_SCORED}, e as (select doc_id, score from s union all select doc_id, blanks / greatest(chars, 1) from s where doc_id % 3 <> 0 union all select doc_id, stops / greatest(chars, 1) from s)
        select doc_id, round(avg(score), 6) as mean_score, count(*) as members, count(*) = 3 as complete from e group by doc_id""",
    "feature_drift": f"""with {_SCORED}, l as (select lang, quality::varchar as label, unnest(['chars', 'lower', 'stops', 'blanks']) as feature, unnest([chars, lower, stops, blanks])::double as v from s),
        g as (select feature, lang, coalesce(label, 'all') as scope, count(v) as n, avg(v) as m, var_pop(v) as s2 from l group by grouping sets ((feature, lang), (feature, lang, label)))
        select x.feature, x.lang, x.scope, x.n, round(x.m, 6) as mean, round(sqrt(x.s2), 6) as sd, round(case when sqrt((x.s2 + b.s2) / 2) > 0 then (x.m - b.m) / sqrt((x.s2 + b.s2) / 2) when x.m = b.m then 0 end, 6) as smd
        from g x join g b on x.feature = b.feature and x.scope = b.scope and b.lang = 'en' where x.lang <> 'en'""",
    "ks_drift": """with m as (select event_type, floor((min(event_id) + max(event_id)) / 2) as mid from events group by 1), e as (select event_type, value as v, (event_id > mid)::int as side from events join m using (event_type) where value is not null),
        p as (select event_type, v, count(*) filter (side = 0) as a, count(*) filter (side = 1) as b from e group by all),
        c as (select event_type, sum(a) over u / sum(a) over w as fa, sum(b) over u / sum(b) over w as fb from p window w as (partition by event_type), u as (partition by event_type order by v rows unbounded preceding))
        select event_type, round(max(abs(fa - fb)), 6) as ks from c group by event_type""",
    "high_sim_negative_ratio": f"""with {_SCORED}, q as (select quantile_cont(score, 0.9) as q90 from s where lang = 'en' and quality = 1)
        select lang, count(*) as negatives, count(*) filter (score >= q90) as high, round(any_value(q90), 6) as q90 from s, q where quality = 0 group by lang""",
    "balanced_review_queue": """with r as (select doc_id, lang, row_number() over (partition by lang order by n_chars desc, doc_id)::int as turn, list_position(['fr', 'de', 'es', 'en'], lang) as o from documents)
        select doc_id, lang, turn, row_number() over (order by turn, o) as queue_rank from r""",
    "anti_join_pending": "select source, count(*) filter (l.doc_id is null) as pending, count(*) filter (l.doc_id is not null) as covered from documents d left join (select distinct doc_id from labels) l using (doc_id) group by source",
    "upsert_reviews": f"""with {_UPSERT}, j as (select coalesce(q.doc_id, n.doc_id) as doc_id, q.label as ql, q.note as qn, n.label as nl, nullif(n.note, '') as nn,
        case when q.doc_id is null then 'inserted' when n.doc_id is null then 'unchanged' when q.label is not null then 'kept_labelled' else 'updated' end as action from q full join n on q.doc_id = n.doc_id)
        select doc_id, case when action in ('inserted', 'updated') then coalesce(nl, ql) else ql end as label, case when action in ('inserted', 'updated') then coalesce(nn, qn) else qn end as note, action from j""",
    "skip_missing_reviews": f"""with {_UPSERT} select coalesce(q.doc_id, n.doc_id) as doc_id, case when q.doc_id is not null then coalesce(n.label, q.label) end as label, case when q.doc_id is not null then coalesce(nullif(n.note, ''), q.note) end as note,
        case when q.doc_id is null then 'skipped' when n.doc_id is null then 'unchanged' else 'updated' end as action, case when q.doc_id is null then 'not_in_queue' end as reason from q full join n on q.doc_id = n.doc_id""",
    "bucket_override_decisions": """with d(lang, decision) as (values ('en', 'keep'), ('de', 'drop')), o as (select doc_id from labels where toxic = 1)
        select x.doc_id, x.lang, case when o.doc_id is not null then 'recheck' else d.decision end as decision, case when o.doc_id is not null then 'override' when d.decision is not null then 'bucket' else 'none' end as decided_by
        from documents x left join d using (lang) left join o on o.doc_id = x.doc_id""",
    "head_tail_select": """with h as (select o_orderkey, o_totalprice, 'head' as part from orders order by o_totalprice desc, o_orderkey limit 25), t as (select o_orderkey, o_totalprice, 'tail' as part from orders order by o_totalprice, o_orderkey desc limit 10)
        select * from h union all select * from t where o_orderkey not in (select o_orderkey from h)""",
    "bucketed_queue": f"""with {_SCORED}, b as (select doc_id, score, case when toxic = 1 then 'toxic' when quality = 0 then 'low' when score between 0.7 and 0.8 then 'border' end as bucket from s)
        select * from (select doc_id, bucket, row_number() over (partition by bucket order by score desc, doc_id)::int as bucket_rank, score from b where bucket is not null) where bucket_rank <= 30""",
    "stratified_sample": """with l as (select doc_id, lang, quality from labels join documents using (doc_id)), z as (select lang, quality, count(*) as n from l group by all), w as (select round(sum(n) * 0.2::double)::bigint as want from z),
        b as (select *, least(n, greatest(floor(n * 0.2::double), 2)) as base, round(n * 0.2::double - floor(n * 0.2::double), 9) as part from z),
        p as (select *, greatest((select want from w) - sum(base) over (), 0) as spare, sum((base < n)::int) over (order by part desc, lang, quality rows unbounded preceding) as place from b),
        q as (select lang, quality, base + (base < n and place <= spare)::int as quota from p)
        select doc_id, lang, quality from (select l.*, quota, row_number() over (partition by lang, quality order by doc_id) as k from l join q using (lang, quality)) where k <= quota""",
    "hard_boundary_sample": f"""with {_SCORED}, n as (select count(*) as n, count(*) filter (quality = 0) as neg, count(*) filter (quality = 1) as pos, round_even(count(*) * 0.5::double, 0)::bigint as want from s),
        q as (select least(neg, greatest(1, round_even(want * 0.35::double, 0)::bigint)) as qn, least(pos, greatest(1, round_even(want * 0.35::double, 0)::bigint)) as qp, want from n),
        a as (select doc_id, score, quality, 'hard_negative' as kind from (select *, row_number() over (order by score desc, doc_id) as k from s where quality = 0), q where k <= qn),
        b as (select doc_id, score, quality, 'hard_positive' as kind from (select *, row_number() over (order by score, doc_id) as k from s where quality = 1), q where k <= qp),
        m as (select quality, median(score) as mid from s group by quality),
        c as (select doc_id, score, quality, 'typical' as kind from (select s.*, row_number() over (order by round(abs(score - mid), 9), doc_id) as k from s join m using (quality) where doc_id not in (select doc_id from a union all select doc_id from b)), q where k <= want - qn - qp)
        select * from a union all select * from b union all select * from c""",
    "fixed_logistic_score": f"with {_SCORED} select doc_id, round(1 / (1 + exp(-greatest(least(0.25::double + (chars - 1000) / 500 * 0.5::double + (stops - 40) / 20 * -0.75::double, 35), -35))), 6) as prob_positive from s",
    "model_choice": f"""with {_SCORED}, l as (select lang as family, quality, unnest(['lower', 'size', 'blanks']) as model_id, unnest([score, chars::double, -blanks::double]) as score from s),
        r as (select *, rank() over (partition by family, model_id order by score) + (count(*) over (partition by family, model_id, score) - 1) / 2.0::double as r from l),
        a as (select family, model_id, count(*) as rows, sum(quality)::bigint as positives, case when sum(quality) > 0 and sum(quality) < count(*) then round((sum(r) filter (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::double) / (sum(quality) * (count(*) - sum(quality))), 6) end as auc from r group by all)
        select family, model_id, rows, positives, auc from (select *, row_number() over (partition by family order by auc desc nulls last, rows desc, model_id) as k from a) where k = 1""",
}
