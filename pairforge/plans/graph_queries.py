"""Queries over graphs of documents, vectors and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import clusters, graph, review, split, vectors
from pairforge.plans import text_queries
from pairforge.plans.tables import table
from pairforge.shared import stash

#: A pair is a candidate if one is among the other's so many nearest of its label.
_NEAREST = 10


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (a, b, score) of vectors of one label of which one is among the other's ten nearest, with their cosine."""
    return vectors.nearest_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _NEAREST, by="label")


def embedding_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pairs(spark, sf_dir)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal edges: pairs among each other's 4 best neighbours."""
    return graph.reciprocal(stash(embedding_pairs(spark, sf_dir), "pairs"), 4)


def reciprocal_topk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)


def shared_neighbor_prune_1pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stash(_graph(spark, sf_dir), "edges")
    return graph.shared_neighbours(edges).filter("shared >= 1")


def triangle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_edges(stash(_graph(spark, sf_dir), "edges")).select("a", "b")


def shared_neighbor_prune_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that remain when those with fewer than two shared neighbours go until none does."""
    return graph.prune_by_neighbours(_graph(spark, sf_dir), 2)


def filter_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of edges after each of the graph's filters."""
    edges = embedding_pairs(spark, sf_dir).withColumn("reliability", F.least(F.lit(1.0), F.col("score") + 0.3))
    _, counts = graph.filter_cascade(edges, threshold=0.2, reliability=0.52, k=5, least_shared=1, rounds=1)
    return spark.createDataFrame([(i, name, n) for i, (name, n) in enumerate(counts)], "step int, filter string, edges bigint")


def clone_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal signatures or equal first lines, as components: (id, component)."""
    signatures = text_queries.clone_signatures(spark, sf_dir)
    lead = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.substring_index("text", "\n", 1)).alias("value")).filter(F.length(F.trim(F.substring_index("text", "\n", 1))) >= 40)
    both = signatures.unionByName(lead).filter("value is not null")
    # a star around the least id of each value has the components of all its pairs, at one edge for each id
    first = both.groupBy("value").agg(F.min("id").alias("a"))
    return graph.connected_components(both.join(first, "value").select("a", F.col("id").alias("b")).distinct())


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clone_components(spark, sf_dir)


def identity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that three seed parts reach through orders, with the round they came in: an order with any active part activates all of its parts."""
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_partkey").alias("key"))
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "key bigint")
    return graph.closure(facts, seeds)


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = stash(_graph(spark, sf_dir).filter("score >= 0.2"), "edges")
    return edges, stash(graph.connected_components(edges), "components")


def cluster_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_stats(*_clusters(spark, sf_dir))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.member_ranks(*_clusters(spark, sf_dir))


def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reciprocal edges with marks of evidence that follow from the ends' numbers, as reviews would have left them."""
    n = F.col("a") + F.col("b")
    edges = _graph(spark, sf_dir).withColumns({
        "contact": n % 7 == 0, "fingerprint": n % 31 == 0, "title": n % 3 == 0, "description": n % 5 == 1, "proof": (n % 7 == 0) & (n % 2 == 0), "label": F.when(n % 4 == 0, "positive").when(n % 4 == 1, "negative").when(n % 4 == 2, "uncertain"),
    })
    whole = lambda c: F.col(c).cast("int")
    stratum = review.evidence_stratum(F.lit(False), whole("contact"), whole("fingerprint"), whole("title"), whole("description"), F.col("score"), F.col("score") + 0.2)
    return edges.withColumn("stratum", stratum)


def cluster_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's edges by evidence, and what that allows to say of it."""
    edges = stash(evidence_edges(spark, sf_dir).filter("score >= 0.2"), "edges")
    members = graph.connected_components(edges)
    counts = clusters.edge_evidence(edges, members)
    read = review.cluster_decision(*(F.col(c) for c in ("edges", "proof", "identifiers", "contacts", "fingerprints", "titles", "descriptions", "text_strata", "semantic_strata")))
    return counts.withColumn("d", read).select("component", "edges", "proof", "identifiers", "titles", "descriptions", "text_strata", "semantic_strata", "d.decision", "d.confidence", "d.use")


def member_set_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters at two thresholds with equal members as one, named by their member set, with where they appear."""
    pairs = stash(_graph(spark, sf_dir), "edges")
    sets = None
    for cut in (0.2, 0.3):
        own = graph.connected_components(pairs.filter(F.col("score") >= cut)).groupBy("component").agg(F.count("*").alias("size"), graph.set_id(F.collect_set(F.col("id").cast("string"))).alias("set_id")).withColumn("cut", F.lit(cut))
        sets = own if sets is None else sets.unionByName(own)
    return sets.groupBy("set_id").agg(F.max("size").alias("size"), F.count("*").alias("appearances"), F.min("cut").alias("first_cut"))


def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole components of labelled documents given to train, valid and test, every split with good and bad ones of each language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    members = clone_components(spark, sf_dir)
    rows = labels.join(members, labels["doc_id"] == members["id"], "left").select(F.coalesce("component", "doc_id").alias("component"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"), F.col("lang").alias("stratum"))
    need = [{"label": label, "stratum": lang, "splits": ["train", "valid", "test"], "severity": severity, "least_in_pool": 3} for label, severity in (("positive", "error"), ("negative", "warning")) for lang in ("de", "en", "es", "fr")]
    return split.split_components(split.component_table(rows, "component", "label", "stratum"), {"train": 0.55, "valid": 0.2, "test": 0.25}, requirements=need, most_components=1_000_000)


def capped_greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best edges with no vector in more than two of them."""
    edges = embedding_pairs(spark, sf_dir).select(F.col("a").alias("left"), F.col("b").alias("right"), "score")
    return split.capped_greedy(edges, [F.desc("score")], most=50, each=2)


def mixup_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").filter("label = 1")
    out = split.mixup(own, "vec_id", "embedding")
    return out.select("synthetic_id", "left", "right", F.round("share", 6).alias("share"), F.round(F.get("vector", F.lit(0)), 5).alias("first_value"))


QUERIES = {
    f.__name__: f
    for f in (
        embedding_cosine_pairs, reciprocal_topk_edges, shared_neighbor_prune_1pass, triangle_edges, shared_neighbor_prune_fixpoint, filter_cascade_counts, connected_components, identity_closure,
        cluster_topology, cluster_members, cluster_decision, member_set_hash_dedupe, component_split, capped_greedy_select, mixup_augment,
    )
}

_ALL = """v as (select vec_id, label, list_transform(embedding, lambda e: e::double) as e from embeddings),
raw as (select x.vec_id as a, y.vec_id as b, list_sum(list_transform(generate_series(1, len(x.e)), lambda i: x.e[i] * y.e[i]))
    / (sqrt(list_sum(list_transform(x.e, lambda e: e * e))) * sqrt(list_sum(list_transform(y.e, lambda e: e * e)))) as c
    from v x join v y on x.label = y.label and x.vec_id < y.vec_id),
every as (select a, b, round(c, 6) as score, round(c, 9) as fine from raw)"""
_PAIRS = f"""{_ALL}, ends as (select a as s, b as d, fine from every union all select b, a, fine from every),
close as (select s, d from (select *, row_number() over (partition by s order by fine desc, d) as k from ends) where k <= {_NEAREST}),
pairs as (select a, b, score from every where (a, b) in (select (s, d) from close) or (b, a) in (select (s, d) from close))"""
_EDGES = f"""{_ALL}, both_ways as (select a as s, b as d, score from every union all select b, a, score from every),
top as (select s, d from (select *, row_number() over (partition by s order by score desc, d) as k from both_ways) where k <= 4),
edges as (select a, b, score from every where (a, b) in (select (s, d) from top) and (b, a) in (select (s, d) from top)),
sym as (select a as s, b as d from edges union select b, a from edges),
shared as (select a, b, score, (select count(*) from sym x join sym y on x.d = y.d where x.s = a and y.s = b) as shared from edges)"""


def _components(edges: str, name: str = "members") -> str:
    return f"""{name}_links as (select a as s, b as d from {edges} union select b, a from {edges} union select a, a from {edges} union select b, b from {edges}),
{name}_reach(id, root) as (select s, d from {name}_links union select r.id, l.d from {name}_reach r join {name}_links l on r.root = l.s),
{name} as (select id, min(root) as component from {name}_reach group by id)"""


_CLUSTERS = f"{_EDGES}, kept as (select * from edges where score >= 0.2), {_components('kept')}"
_INSIDE = "inside as (select component, count(*) as edges, min(score) as lo, avg(score) as mean, max(score) as hi, 1 as one from kept join members on a = id group by component)"

_MARKED = """f as (select *, (a + b) % 7 = 0 as contact, (a + b) % 31 = 0 as fingerprint, (a + b) % 3 = 0 as title, (a + b) % 5 = 1 as description, (a + b) % 7 = 0 and (a + b) % 2 = 0 as proof,
    case (a + b) % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'uncertain' end as label from kept),
marked as (select *, case when (contact or fingerprint) and (title or description) then 'identifier_plus_text' when title or description then 'text_clone_primary' when contact or fingerprint then 'identifier_primary'
    when score > 0 and score + 0.2 >= 0.5 then 'semantic_structural' else 'semantic_only' end as stratum from f)"""

ORACLE = {
    "embedding_cosine_pairs": f"with {_PAIRS} select * from pairs",
    "reciprocal_topk_edges": f"with {_EDGES} select * from edges",
    "shared_neighbor_prune_1pass": f"with {_EDGES} select * from shared where shared >= 1",
    "triangle_edges": f"with {_EDGES} select a, b from shared where shared >= 1",
    "filter_cascade_counts": f"""with {_PAIRS}, e1 as (select * from pairs where score >= 0.2), e2 as (select * from e1 where least(1.0, score + 0.3) >= 0.52),
        w as (select a as s, b as d, score from e2 union all select b, a, score from e2), t as (select s, d from (select *, row_number() over (partition by s order by score desc, d) as k from w) where k <= 5),
        e3 as (select * from e2 where (a, b) in (select (s, d) from t) and (b, a) in (select (s, d) from t)), y as (select a as s, b as d from e3 union select b, a from e3),
        e4 as (select * from e3 where exists (select 1 from y p join y q on p.d = q.d where p.s = a and q.s = b))
        select 0 as step, 'all' as filter, count(*) as edges from pairs union all select 1, 'threshold', count(*) from e1 union all select 2, 'reliability', count(*) from e2
        union all select 3, 'reciprocal', count(*) from e3 union all select 4, 'shared_neighbours', count(*) from e4""",
    "connected_components": f"""with recursive s as (select id, value from {text_queries.SIGNATURES} union all select doc_id, md5(string_split(text, chr(10))[1]) from documents where length(trim(string_split(text, chr(10))[1], ' ')) >= 40),
        f as (select value, min(id) as a from s group by value), e as (select distinct a, id as b from s join f using (value)), {_components('e')} select * from members""",
    "identity_closure": """with recursive l as (select distinct l_orderkey as fact, l_partkey as key from lineitem),
        r(key, round) as (select unnest([1, 2, 3])::bigint, 0 union select y.key, round + 1 from (select key, min(round) as round from r group by key) r join l x on r.key = x.key join l y on x.fact = y.fact where round < 9)
        select key, min(round)::int as round from r group by key""",
    "cluster_topology": f"""with recursive {_CLUSTERS}, {_INSIDE}, g as (select s, count(*) as degree from (select a as s from kept union all select b from kept) group by s),
        n as (select component, count(*) as size, avg((degree <= 1)::int) as leaf, list_sort(list(id::varchar)) as ids from members join g on id = s group by component)
        select component, size, edges, round(edges * 2 / (size * (size - 1)), 6) as density, round(lo, 6) as min_score, round(mean, 5) as mean_score, round(hi, 6) as max_score, round(leaf, 6) as leaf_share,
            edges = size - 1 as is_tree, substr(sha256(array_to_string(ids, chr(10))), 1, 12) as set_id from n join inside using (component) where size >= 2""",
    "cluster_members": f"""with recursive {_CLUSTERS}, o as (select a as id, score from kept union all select b, score from kept), g as (select id, count(*) as degree, max(score) as max_score from o group by id)
        select component, id, degree, max_score, row_number() over (partition by component order by degree desc, max_score desc, id)::int as rank from members join g using (id)""",
    "cluster_decision": f"""with recursive {_CLUSTERS}, {_MARKED}, c as (select component, count(*) as edges, count(*) filter (proof) as proof, count(*) filter (contact or fingerprint) as identifiers,
            count(*) filter (contact) as contacts, count(*) filter (fingerprint) as fingerprints, count(*) filter (title) as titles, count(*) filter (description) as descriptions,
            count(*) filter (stratum = 'text_clone_primary') as text_strata, count(*) filter (stratum in ('semantic_structural', 'semantic_only')) as semantic_strata from marked join members on a = id group by component),
        d as (select *, case when edges = proof then 'same_controller_high_confidence' when proof >= 2 then 'same_controller_core_with_possible_expansion' when proof = 1 then 'partial_anchor'
            when identifiers > 0 or contacts + fingerprints > 0 then 'uncertain' when greatest(titles, descriptions, text_strata) / edges >= 0.5 then 'template_clone_not_controller'
            when semantic_strata / edges >= 0.5 then 'semantic_topic_not_controller' else 'uncertain' end as decision from c)
        select component, edges, proof, identifiers, titles, descriptions, text_strata, semantic_strata, decision,
            case when decision like 'same_controller%' then 'high' when decision = 'partial_anchor' then 'medium' else 'low' end as confidence,
            case decision when 'same_controller_high_confidence' then 'can_support_same_controller_core_claim' when 'same_controller_core_with_possible_expansion' then 'use_only_identifier_core_for_claim; review_expansion_edges_separately'
                when 'partial_anchor' then 'retain_anchor_pair/core; do_not_claim_full_cluster_without_pair_level_rereview' when 'uncertain' then 'manual_review_before_claim' else 'use_for_review_discovery_only' end as use from d""",
    "member_set_hash_dedupe": f"""with recursive {_EDGES}, k2 as (select * from edges where score >= 0.2), k3 as (select * from edges where score >= 0.3), {_components('k2', 'm2')}, {_components('k3', 'm3')},
        u as (select 0.2::double as cut, component, id from m2 union all select 0.3::double, component, id from m3),
        s as (select cut, component, count(*) as size, substr(sha256(array_to_string(list_sort(list(id::varchar)), chr(10))), 1, 12) as set_id from u group by all)
        select set_id, max(size) as size, count(*) as appearances, min(cut) as first_cut from s group by set_id""",
}
