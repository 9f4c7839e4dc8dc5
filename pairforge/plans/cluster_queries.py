"""Queries of clusters, of reviews of their edges, and of relations' reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import numeric, text
from pairforge.operators import clusters, graph, queues, ranks
from pairforge.plans import graph_queries as g
from pairforge.plans.candidate_queries import _CANDIDATES, candidate_rows
from pairforge.plans.graph_queries import _CLUSTERS, _EDGES, _INSIDE, _MARKED, _components
from pairforge.shared import stash


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = stash(g.evidence_edges(spark, sf_dir).filter("score >= 0.2"), "edges")
    return edges, stash(graph.connected_components(edges), "components")


def cluster_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in order of size and scores, with the class of their size."""
    edges, members = _marked(spark, sf_dir)
    stats = graph.cluster_stats(edges, members)
    return clusters.cluster_ranks(stats).select("component", "size", clusters.size_class(F.col("size")).alias("size_class"), "max_score", "mean_score", F.col("rank").cast("bigint").alias("rank"))


def cluster_member_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.member_table(*_marked(spark, sf_dir))


def cluster_edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's edges from the best on, with their place."""
    from pyspark.sql import Window

    edges, members = _marked(spark, sf_dir)
    own = clusters.inside(edges, members).withColumn("pair", text.pair_key(F.col("a"), F.col("b")))
    return own.select("component", "a", "b", "score", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), "pair")).alias("place"))


# Kinds of contacts that prove a relation, and words of notes that let an e-mail do so or not.
PROOF_KINDS, GOOD_NOTES, BAD_NOTES = ("telegram:", "qq:"), ("seller-facing",), ("public", "template")


def _reviews(edges: DataFrame) -> DataFrame:
    """What reviews said of some of the edges."""
    n = F.col("a") + F.col("b")
    values = F.when(n % 3 == 0, "QQ:12345").when(n % 3 == 1, "email:x@y.org").otherwise("")
    notes = F.when(n % 5 == 0, "Seller-facing contact").when(n % 5 == 1, "seller-facing but public").otherwise("")
    return edges.filter(n % 9 != 0).select("a", "b", F.coalesce("label", F.lit("")).alias("label"), (n % 10 != 4).alias("usable"), (n % 31 == 0).cast("int").alias("fingerprints"), values.alias("contact_values"), notes.alias("notes"))


def edge_label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reviews of the clusters' edges prove, by cluster: the number of edges of each class."""
    edges, members = _marked(spark, sf_dir)
    joined = clusters.inside(edges.select("a", "b"), members).join(_reviews(edges), ["a", "b"], "left")
    read = clusters.label_class(*(F.col(c) for c in ("label", "usable", "fingerprints", "contact_values", "notes")), PROOF_KINDS, GOOD_NOTES, BAD_NOTES)
    return joined.groupBy("component", read.alias("label_class")).agg(F.count("*").alias("edges"))


def run_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike two runs' edges, and two runs' clustered vectors, are: the graph at two thresholds."""
    edges = stash(g.reciprocal_topk_edges(spark, sf_dir), "edges")
    one, other = edges.filter("score >= 0.2"), edges.filter("score >= 0.3 or a % 10 = 0")
    ends = lambda e: e.select(F.explode(F.array("a", "b")).alias("id"))
    made = lambda what, df: df.select(F.lit(what).alias("what"), "*")
    return made("edges", clusters.run_overlap(one, other, ["a", "b"])).unionByName(made("members", clusters.run_overlap(ends(one), ends(other), ["id"])))


def merged_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal member sets of three runs as one: greatest counts and merged strata."""
    edges = stash(g.evidence_edges(spark, sf_dir), "edges")
    runs = None
    for cut in (0.2, 0.25, 0.3):
        kept = stash(edges.filter(F.col("score") >= cut), "edges")
        members = stash(graph.connected_components(kept), "components")
        sets = members.groupBy("component").agg(graph.set_id(F.collect_set(F.col("id").cast("string"))).alias("set_id"))
        strata = clusters.inside(kept, members).groupBy("component", "stratum").agg(F.count("*").alias("n")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("stratum", "n"))).alias("strata"))
        one = clusters.edge_evidence(kept, members).select("component", "edges", "proof", "contacts").join(sets, "component").join(strata, "component")
        runs = one if runs is None else runs.unionByName(one)
    return clusters.merged_appearances(runs, "set_id", ["edges", "proof", "contacts"], "strata")


def proof_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in proved pairs."""
    edges = g.evidence_edges(spark, sf_dir).withColumnsRenamed({"a": "left", "b": "right"})
    return clusters.proof_ends(edges, F.col("proof"))


def retained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that a stored run's threshold kept, by its mark and by its probabilities."""
    scored = g.embedding_pairs(spark, sf_dir).select("a", "b", F.col("score").alias("prob_positive"), (F.col("score") >= 0.25).cast("int").alias("edge_at_threshold_0250000"))
    by_mark = clusters.retained_edges(scored, "edge_at_threshold_0250000", 0.9)
    by_score = clusters.retained_edges(scored.drop("edge_at_threshold_0250000"), "edge_at_threshold_0250000", 0.3)
    return by_mark.select("a", "b", F.lit("mark").alias("kept_by")).unionByName(by_score.select("a", "b", F.lit("score").alias("kept_by")))


def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidate pairs with their reliability, its parts, the final score, whether they pass, marks by threshold, and their rank."""
    rows = candidate_rows(spark, sf_dir)
    relation = numeric.reliability(
        fingerprints=F.col("shared_fingerprint_count"), contacts=F.col("shared_contact_count"), description_clone=F.col("shared_description_count") > 0, description_idf=F.lit(0.0), title_clone=F.col("shared_title_count") > 0,
        title_idf=F.col("shared_title_count") * 0.75, rare_ngrams=F.col("shared_category_count"), support=F.col("structural_support_score"), category=F.col("lexical_similarity"), style=1 - F.col("style_distance_l1"),
        boilerplate_ratio=F.col("lexical_similarity"), boilerplate_count=F.lit(None).cast("double"), semantic=numeric.greatest_of(F.col("lexical_similarity"), F.col("price_median_ratio")),
    )
    own = rows.withColumns({"probability": F.floor(F.col("structural_support_score") * 1000) / 1000, "r": relation})
    marked = queues.threshold_marks(own, "probability", [0.5, 0.735])
    keep = F.col("r.direct") | (F.col("r.score") >= numeric.LEAST_RELIABILITY)
    out = marked.select(
        "pair_uid", "probability", F.col("r.score").alias("reliability"), F.array_join("r.components", " || ").alias("components"), F.col("r.direct").cast("int").alias("direct"), F.col("r.topic_only").cast("int").alias("topic_only"),
        keep.cast("int").alias("passes"), F.round(F.col("probability") * F.col("r.score"), 6).alias("final_score"), "edge_at_0500000", "edge_at_0735000",
    )
    return ranks.global_rank(out, [F.desc("probability"), F.col("pair_uid")], "rank")


def targeted_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the greater clusters as reviews to be made or made again, with the policy of their bucket."""
    edges, members = _marked(spark, sf_dir)
    stats = clusters.cluster_ranks(graph.cluster_stats(edges, members)).filter("size >= 4").select(F.col("component").alias("_c"), F.col("rank").cast("bigint").alias("cluster_rank"))
    own = clusters.inside(edges, members).join(stats, F.col("component") == F.col("_c"))
    reviewed = _reviews(edges).select("a", "b", F.col("label").alias("review_label"))
    return queues.routed(own.join(reviewed, ["a", "b"], "left")).select("a", "b", "cluster_rank", "bucket", "target_bucket", "suggested_label", "route")


QUERIES = {
    f.__name__: f
    for f in (
        cluster_ranks, cluster_member_table, cluster_edge_order, edge_label_classes, run_overlaps, merged_appearances, proof_entities, retained_edges, pair_records, targeted_queue,
    )
}

_STATS = f"""{_CLUSTERS}, {_MARKED}, {_INSIDE}, sizes as (select component, count(*) as size from members group by component),
ranked as (select component, size, round(hi, 6) as max_score, round(mean, 5) as mean_score, row_number() over (order by size desc, round(hi, 6) desc, round(mean, 5) desc, component) as rank from sizes join inside using (component) where size >= 2)"""
_REVIEWS = """reviews as (select a, b, coalesce(label, '') as label, (a + b) % 10 <> 4 as usable, ((a + b) % 31 = 0)::int as fingerprints, case (a + b) % 3 when 0 then 'QQ:12345' when 1 then 'email:x@y.org' else '' end as v,
    case (a + b) % 5 when 0 then 'Seller-facing contact' when 1 then 'seller-facing but public' else '' end as n from marked where (a + b) % 9 <> 0)"""


def _run(cut: float, k: int) -> str:
    return f"""k{k} as (select * from all_marked where score >= {cut}), {_components(f'k{k}', f'm{k}')},
    s{k} as (select component, substr(sha256(array_to_string(list_sort(list(id::varchar)), chr(10))), 1, 12) as set_id from m{k} group by component),
    r{k} as (select set_id, stratum, e, p, c, n from s{k} join (select component, count(*) as e, count(*) filter (proof) as p, count(*) filter (contact) as c from k{k} join m{k} on a = id group by component) using (component)
        join (select component, stratum, count(*) as n from k{k} join m{k} on a = id group by all) using (component))"""


ORACLE = {
    "cluster_ranks": f"""with recursive {_STATS} select component, size, case when size = 2 then 'size_2' when size <= 5 then 'size_3_to_5' when size <= 10 then 'size_6_to_10' else 'size_11_plus' end as size_class, max_score, mean_score, rank from ranked""",
    "cluster_member_table": f"""with recursive {_CLUSTERS}, o as (select a as id, b as other, score from kept union all select b, a, score from kept), n as (select *, row_number() over (partition by id order by score desc, other) as k from o),
        d as (select component, id, count(*) as degree, round(sum(score), 6) as score_sum, floor(sum(round(score * 1000000)::bigint) / count(*)) / 1000000 as score_mean, max(score) as score_max, string_agg(other::varchar, ' || ' order by k) filter (k <= 3) as strongest from n join members using (id) group by all)
        select *, row_number() over (partition by component order by degree desc, score_max desc, id)::int as rank from d""",
    "cluster_edge_order": f"""with recursive {_CLUSTERS} select component, a, b, score, row_number() over (partition by component order by score desc, least(a::varchar, b::varchar) || '||' || greatest(a::varchar, b::varchar))::int as place from kept join members on a = id""",
    "edge_label_classes": f"""with recursive {_CLUSTERS}, {_MARKED}, {_REVIEWS}, j as (select component, r.* from marked m join members on m.a = id left join reviews r on r.a = m.a and r.b = m.b),
        c as (select component, case when label is null then 'missing' when label = '' then 'blank' when label = 'positive' and usable and (fingerprints > 0 or contains(lower(v), 'telegram:') or contains(lower(v), 'qq:')
            or contains(v, 'email:') and contains(lower(n), 'seller-facing') and not contains(lower(n), 'public') and not contains(lower(n), 'template')) then 'proof_positive' when label = 'positive' then 'nonproof_positive' else label end as label_class from j)
        select component, label_class, count(*) as edges from c group by all""",
    "run_overlaps": f"""with {_EDGES}, x as (select a, b from edges where score >= 0.2), y as (select a, b from edges where score >= 0.3 or a % 10 = 0), xm as (select a as id from x union select b from x), ym as (select a as id from y union select b from y),
        c as (select 'edges' as what, (select count(*) from x) as first, (select count(*) from y) as second, (select count(*) from x join y using (a, b)) as both
            union all select 'members', (select count(*) from xm), (select count(*) from ym), (select count(*) from xm join ym using (id)))
        select *, case when first + second - both > 0 then round(both / (first + second - both), 6) else 0 end as jaccard from c""".replace(" as both", ' as "both"').replace("- both", '- "both"').replace("round(both", 'round("both"'),
    "merged_appearances": f"""with recursive {_EDGES}, {_MARKED.replace("from kept", "from edges").replace("marked as", "all_marked as")}, {_run(0.2, 1)}, {_run(0.25, 2)}, {_run(0.3, 3)},
        u as (select 1 as run, * from r1 union all select 2, * from r2 union all select 3, * from r3), t as (select set_id, stratum, sum(n)::bigint as n from u group by all), w as (select distinct run, set_id, e, p, c from u)
        select set_id, appearances, max_edges, max_proof, max_contacts, strata from (select set_id, count(*) as appearances, max(e) as max_edges, max(p) as max_proof, max(c) as max_contacts from w group by set_id)
        join (select set_id, string_agg(stratum || ':' || n, '|' order by stratum) as strata from t group by set_id) using (set_id)""",
    "proof_entities": f"with {_EDGES}, p as (select a, b from edges where (a + b) % 14 = 0) select entity, count(*) as proved_pairs from (select a as entity from p union all select b from p) group by entity",
    "retained_edges": f"with {g._PAIRS} select a, b, 'mark' as kept_by from pairs where score >= 0.25 union all select a, b, 'score' from pairs where score >= 0.3",
    "pair_records": f"""with {_CANDIDATES}, p as (select *, floor(structural_support_score * 1000) / 1000 as probability, shared_fingerprint_count > 0 as f, shared_contact_count > 0 as c, shared_title_count > 0 and shared_title_count * 0.75 >= 2 as t,
            shared_category_count >= 2 as n, structural_support_score >= 0.5 or lexical_similarity >= 0.5 as s, 1 - style_distance_l1 >= 0.72 as y, lexical_similarity >= 0.75 as bp,
            greatest(lexical_similarity, coalesce(price_median_ratio, 0)) >= 0.75 and not (shared_fingerprint_count > 0 or shared_contact_count > 0) and not (shared_title_count > 0 or structural_support_score >= 0.5 or lexical_similarity >= 0.5) as o from cand),
        rel as (select *, round(greatest(0, least(1, 0.2::double + case when f then 0.45 else 0 end + case when c then 0.35 else 0 end + case when t then 0.1 else 0 end + case when n then 0.08 else 0 end + case when s then 0.12 else 0 end
                + case when y then 0.08 else 0 end - case when bp then 0.2 else 0 end - case when o then 0.25 else 0 end)), 6) as reliability,
            array_to_string(list_filter([case when f then '+shared_pgp_fingerprint:0.450' end, case when c then '+shared_seller_contact:0.350' end, case when t then '+rare_title_clone:0.100' end, case when n then '+rare_ngram_support:0.080' end,
                case when s then '+structural_support:0.120' end, case when y then '+style_consistency:0.080' end, case when bp then '-0.200:boilerplate_template_penalty' end, case when o then '-0.250:semantic_topic_only_penalty' end], lambda x: x is not null), ' || ') as components from p)
        select pair_uid, probability, reliability, components, (f or c)::int as direct, o::int as topic_only, (f or c or reliability >= 0.3)::int as passes, round(probability * reliability, 6) as final_score, (probability >= 0.5)::int as edge_at_0500000,
            (probability >= 0.735)::int as edge_at_0735000, row_number() over (order by probability desc, pair_uid) as rank from rel""",
    "targeted_queue": f"""with recursive {_STATS}, {_REVIEWS}, j as (select m.*, component, r.label as review_label from marked m join members on m.a = id left join reviews r on r.a = m.a and r.b = m.b),
        b as (select j.*, ranked.rank as cluster_rank, case when contact or fingerprint then 'identifier_anchor' when stratum = 'text_clone_primary' then 'template_clone' else 'semantic_or_structural' end as bucket from j join ranked using (component) where size >= 4)
        select a, b, cluster_rank, bucket, 'cluster_' || lpad(cluster_rank::varchar, 4, '0') || '_' || bucket as target_bucket, case when bucket = 'identifier_anchor' then 'positive_candidate' else 'uncertain_candidate' end as suggested_label,
            case when review_label is null or review_label = '' then 'queue' else 'rereview' end as route from b""",
}
