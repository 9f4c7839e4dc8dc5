"""Queries of text forms, small numeric functions, and operators on graphs, samples and ranks that others build on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import numeric, text
from pairforge.operators import features, graph, ml, profile, queues, review, reviewers, rules
from pairforge.plans.eval_queries import _SCORED, scored_labels
from pairforge.plans.graph_queries import _CLUSTERS, _components, evidence_edges
from pairforge.plans.tables import table
from pairforge.plans.text_queries import TERMS, source_terms

def _line():
    return F.substring_index("text", "\n", 1)


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of each document's first line, and of keys made of its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _line().alias("x"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), "source", "n_chars")
    noted = F.concat(F.substring("x", 1, 12), F.when(F.col("doc_id") % 3 == 0, F.lit(" (97%) ")).otherwise(" "))
    key = F.concat(F.lit("0x"), F.upper("h"), F.lit(" "), F.col("h"))
    listed = F.concat_ws(" || ", F.substring("x", 1, 3), F.lit(" "), F.substring("x", 4, 3), F.col("source"))
    return docs.select(
        "doc_id", text.alias_key(noted).alias("alias"), text.soft_alias(noted).alias("soft"), F.length(text.clipped(F.col("x"), 20)).alias("clipped"), F.md5(text.clipped(F.col("x"), 20, strip=False)).alias("clipped_raw"),
        F.md5(text.cut_hard(F.col("x"), 20)).alias("cut"), text.fingerprint(key).alias("fingerprint"), text.short_fingerprint(key).alias("short_fingerprint"),
        F.array_join(F.transform(text.id_list(F.concat_ws(", ", F.col("n_chars").cast("string"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))), lambda v: v.cast("string")), ",").alias("ids"),
        F.array_join(text.listed(listed), "|").alias("items"), text.key_block_digest(F.concat("x", F.lit("\n "), "h")).alias("block"), text.truthy(F.when(F.col("doc_id") % 4 == 0, F.lit(" Yes")).when(F.col("doc_id") % 4 == 1, F.lit("1"))).alias("truthy"),
        text.first_present(F.when(F.col("doc_id") % 2 == 0, F.lit("  ")), F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.lit("none")).alias("name"), text.contact_key(F.lit("qq"), F.col("n_chars").cast("string")).alias("qq"),
        numeric.safe_ratio(F.col("doc_id"), F.col("n_chars") % 7).alias("ratio"),
    )


def alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of documents that follow each other as aliases: equal in soft form, edits up to a limit, relation, scope."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.substring(_line(), 1, 6), "[^A-Za-z ]", "").alias("alias"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("alias").alias("other"))
    a, b = text.alias_key(F.col("alias")), text.alias_key(F.col("other"))
    edits = F.levenshtein(a, b, 3)
    return docs.join(other, "doc_id").select(
        "doc_id", (text.soft_alias(F.col("alias")) == text.soft_alias(F.col("other"))).alias("soft_same"), ((text.soft_alias(F.col("alias")) == text.soft_alias(F.col("other"))) & (F.col("alias") != F.col("other"))).alias("soft_same_other_raw"),
        F.when(edits < 0, 4).otherwise(edits).alias("edits"), text.alias_relation(a, b).alias("relation"), text.candidate_scope(a, b).alias("scope"),
    )


def style_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of style between documents that follow each other: sum, number of great ones, consistency, distance from a boundary, strength of clones."""
    own = scored_labels(spark, sf_dir).select("doc_id", *(F.round(F.col(c) / F.greatest("chars", F.lit(1)), 6).alias(c) for c in ("lower", "stops", "blanks")), "score")
    other = own.select(F.col("doc_id").alias("other"), *(F.col(c).alias(f"_{c}") for c in ("lower", "stops", "blanks")))
    both = own.join(other, (F.col("doc_id") + 1) == F.col("other"), "left")
    gaps = [F.when(F.abs(F.col(c) - F.col(f"_{c}")) < 0.9, F.round(F.abs(F.col(c) - F.col(f"_{c}")), 6)) for c in ("lower", "stops", "blanks")]
    return both.select(
        "doc_id", F.round(features.gap_sum(gaps), 6).alias("gap_sum"), features.gap_hits(gaps, 0.02).alias("gap_hits"), F.round(numeric.style_consistency(gaps), 6).alias("consistency"), F.round(F.abs(F.col("score") - 0.75), 6).alias("boundary_distance"),
        features.clone_strength(F.col("doc_id") % 3, F.col("doc_id") % 2).cast("bigint").alias("clone_strength"),
    )


def signature_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's words by how many sources have them: boilerplate, rare ones, sum of their specificity."""
    words = source_terms(spark, sf_dir).select("source", "term").distinct()
    df = words.groupBy("term").agg(F.count("*").alias("entity_df"))
    total = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("_all"))
    out = features.signature_state(words.join(df, "term").join(F.broadcast(total), F.lit(True)), "source", F.col("_all"), boilerplate=0.5, rare=0.1)
    return out.withColumn("idf_sum", F.round("idf_sum", 4)).withColumn("boilerplate_ratio", F.round("boilerplate_ratio", 6))


def own_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines without those that many documents have; at least the rarest one stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "segment"))
    total = table(spark, sf_dir, "documents").count()
    out = features.without_boilerplate(docs, "doc_id", F.lit(total), share=0.01, least_chars=8, least_kept=1)
    return out.select("doc_id", F.md5("text").alias("text"))


def consistent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over edges that reviews call positive, without those that hold both ends of a negative one."""
    edges = evidence_edges(spark, sf_dir)
    return graph.consistent_components(edges.filter("label = 'positive'").select("a", "b"), edges.filter("label = 'negative'").select("a", "b"))


def closure_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pairs inside those components, at most five of each."""
    edges = evidence_edges(spark, sf_dir)
    return graph.closure_pairs(consistent_clusters(spark, sf_dir), edges.select("a", "b"), 5)


def best_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's best order by price, then priority, then key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return rules.best_appearance(orders, "o_custkey", ["-o_totalprice", "o_orderpriority", "o_orderkey"])


def appended_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labelled documents ranked after a queue of the first hundred."""
    labels = table(spark, sf_dir, "labels")
    existing = labels.filter("toxic = 0").select("doc_id", (F.col("doc_id") % 100).alias("place"))
    return review.appended_ranks(labels.filter("toxic = 1").select("doc_id"), existing, "place", [F.col("doc_id")]).select("doc_id", F.col("place").cast("bigint").alias("place"))


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three queues' documents are read in any, and which wait in all of them."""
    labels = table(spark, sf_dir, "labels")
    queue = lambda k: labels.select("doc_id", F.when(F.col("doc_id") % (k + 3) == 0, F.lit(" Done")).when(F.col("doc_id") % 2 == 0, F.lit("Pending ")).alias("review_status"), F.when(F.col("doc_id") % (k + 9) == 1, F.lit("positive")).otherwise(F.lit(" ")).alias("review_label"))
    read = queues.reviewed_keys([queue(k) for k in range(3)], "doc_id").withColumn("read", F.lit(True))
    return labels.join(read, "doc_id", "left").select("doc_id", F.coalesce("read", F.lit(False)).alias("read"))


def weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with balanced weights and standardised sizes; every tenth size is missing and counts as the mean."""
    own = scored_labels(spark, sf_dir).select("doc_id", "quality", F.when(F.col("doc_id") % 10 != 0, F.col("chars").cast("double")).alias("size"), "blanks")
    model = ml.standardise(own, ["size", "blanks"])
    size, blanks = model.standardised()
    return ml.balanced_weights(own, "quality").select("doc_id", F.round("weight", 6).alias("weight"), F.round(size, 5).alias("size"), F.round(blanks, 5).alias("blanks"))


def source_value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's four most frequent words as one text, and their number with the first and last document that has them."""
    counts = profile.value_counts(source_terms(spark, sf_dir), ["source"], "term", "doc_id")
    top = profile.top_values(counts, ["source"], 4)
    said = profile.nested(top, ["source"], "values").select("source", F.array_join(F.transform("values", lambda v: v["value"]), " || ").alias("text"))
    ends = source_terms(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("words"))
    return said.join(ends, "source")


def pages_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host or first path part is among the active keys, and what else is known of them."""
    pages = table(spark, sf_dir, "pages").withColumn("key", text.url_key(F.col("url"), 1))
    active = pages.filter("page_id % 9 = 0").select("key").distinct()
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").cast("string").alias("note"))
    kept = pages.join(active, "key", "left_semi").join(notes, "page_id", "left")
    return kept.select("page_id", "key", F.coalesce("note", F.lit("0")).alias("note"), F.concat_ws("\n", F.concat(F.lit("Key: "), "key"), F.when(F.col("note").isNotNull(), F.concat(F.lit("Note: "), "note"))).alias("section"))


def boundary_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules' readings of labelled documents as pairs near a boundary: their scores stand for likeness and gaps."""
    own = scored_labels(spark, sf_dir)
    n = F.col("doc_id")
    bucket = F.when(n % 3 == 0, "positive_probe_high_semantic_high_structure").when(n % 3 == 1, "negative_probe_high_semantic_style_divergence")
    read = reviewers.boundary_review(bucket, (n % 2).cast("string"), (n % 17 == 0).cast("int"), F.col("score") + 0.15, F.col("score"), F.col("score") + 0.05, (n % 4) * F.col("score"), n % 3)
    return own.select("doc_id", read.alias("r")).select("doc_id", "r.label", "r.reason", "r.rule")


# What stands around tokens that two sellers share.
CONTEXTS = ["write on 微信", "see youtube.com/watch?v=1", "plain words", "数据格式 sample", "MEGA and tg"]


def anchor_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules' readings of labelled documents as pairs that share a token, and as pairs that a model scores highly."""
    own = table(spark, sf_dir, "labels").select("doc_id")
    n = F.col("doc_id")
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    kind, token, context = at(["WeChat", "external_url", "qq", "bat", "fax", "telegram"], n), at(["wechat:Store", "url:x.org", "qq:12345", "Support", "a_shop"], F.floor(n / 6)), at(CONTEXTS, F.floor(n / 30))
    one = reviewers.anchor_review(kind, token, (n % 13 == 0).cast("int"), (n % 7 != 0).cast("int"), context)
    other = reviewers.targeted_review(F.when(n % 4 == 0, F.concat(F.lit("qq:"), n.cast("string"))).when(n % 4 == 1, F.lit("email:a@b.c")), (n % 5 == 0).cast("int"), context)
    return own.select("doc_id", one["label"].alias("anchor_label"), one["reason"].alias("anchor_reason"), other["label"].alias("targeted_label"), other["reason"].alias("targeted_reason"))


def source_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules' readings of documents as pairs of the source's own expansion, by facts that follow from their number, and as pairs around anchors."""
    own = table(spark, sf_dir, "documents").select("doc_id")
    n = F.col("doc_id")
    bucket = F.element_at(F.array(*map(F.lit, ("seller_facing_identifier_plus_text", "strong_text_clone_positive_probe", "english_hard_negative_template_probe", "other"))), (n % 4 + 1).cast("int"))
    facts = {f: (F.floor(n / (k + 3)) % (k % 3 + 2)) == 1 for k, f in enumerate(reviewers.SOURCE_FACTS)}
    facts = facts | {"soft_same_alias": n % 19 == 0, "fingerprint": n % 23 == 0}
    one = reviewers.source_review(bucket, F.floor(n / 4) % 5, F.floor(n / 20) % 4, facts)
    anchored = F.element_at(F.array(*map(F.lit, (
        "positive_component_transitive_closure", "supplemental_shared_seller_contact", "rare_external_url_with_text_overlap", "cross_market_unique_alias_closure", "direct_contact_existing_pending", "none"))), (n % 6 + 1).cast("int"))
    token = F.element_at(F.array(*map(F.lit, ("telegram:shop", "crypto_wallet:1x", "Email:a@b", "bat:1", "telegram:https", "url:youtube.com"))), (F.floor(n / 6) % 6 + 1).cast("int"))
    flag = lambda k: F.floor(n / k) % 3 == 0
    other = reviewers.positive_anchor_review(
        anchored, token, (n % 16) / 100, (n % 11) / 20, n % 29 == 0, evidence=F.when(flag(5), "strong_contact").otherwise("weak"), facing=flag(7), victim=flag(11), wallet=flag(13), product_url=flag(17), own_url=flag(2)
    )
    return own.select("doc_id", one["label"].alias("source_label"), one["rule"].alias("source_rule"), other["label"].alias("anchor_label"), other["rule"].alias("anchor_rule"))


QUERIES = {
    f.__name__: f
    for f in (
        source_reviews, boundary_reviews, anchor_reviews, text_forms, alias_pairs, style_gaps, signature_states, own_lines, consistent_clusters, closure_candidates, best_appearances, appended_queue, pending_rows, weighted_rows, source_value_texts, pages_of_keys,
    )
}

_FIRST = "string_split(text, chr(10))[1]"
_MARKS = """f as (select a, b, case (a + b) % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'uncertain' end as label from edges), pos as (select a, b from f where label = 'positive')"""
_CONSISTENT = f"""{{edges}}, {_MARKS}, {_components('pos', 'pm')}, bad as (select x.component from f join pm x on f.a = x.id join pm y on f.b = y.id where label = 'negative' and x.component = y.component), good as (select * from pm where component not in (select component from bad))"""
_EDGE_CTES = _CLUSTERS[: _CLUSTERS.index(", kept as")]

ORACLE = {
    "text_forms": rf"""with d as (select doc_id, {_FIRST} as x, md5(coalesce(text, '')) as h, source, n_chars, substr({_FIRST}, 1, 12) || case when doc_id % 3 = 0 then ' (97%) ' else ' ' end as n from documents),
        k as (select *, upper(regexp_replace('0x' || upper(h) || ' ' || h, '(?i)^0x|[^0-9A-Fa-f]', '', 'g')) as fp, lower(trim(regexp_replace(n, '[\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'), ' ')) as al from d)
        select doc_id, al as alias, regexp_replace(regexp_replace(al, '\s*\([0-9]+(\.[0-9]+)?%\)\s*$', ''), '[^\p{{L}}\p{{N}}]+', '', 'g') as soft, length(case when length(x) > 20 then rtrim(substr(x, 1, 17), ' ') || '...' else x end)::int as clipped,
            md5(case when length(x) > 20 then substr(x, 1, 17) || '...' else x end) as clipped_raw, md5(case when length(x) > 20 then rtrim(substr(x, 1, 20), ' ') else x end) as cut, fp as fingerprint, '0x' || right(fp, 16) as short_fingerprint,
            array_to_string(case when n_chars = doc_id then [n_chars] else [n_chars, doc_id] end, ',') as ids, array_to_string(list_filter(list_transform([substr(x, 1, 3), substr(x, 4, 3), source], lambda v: trim(v, ' ')), lambda v: v <> ''), '|') as items,
            sha256(regexp_replace(x || chr(10) || ' ' || h, '[\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', '', 'g')) as block, doc_id % 4 in (0, 1) as truthy, case when doc_id % 3 = 0 then source else 'none' end as name,
            case when length(n_chars::varchar) between 5 and 12 then n_chars::varchar end as qq, coalesce(case when n_chars % 7 <> 0 then round(doc_id / (n_chars % 7), 6) end, 0) as ratio from k""",
    "alias_pairs": rf"""with d as (select doc_id, regexp_replace(substr({_FIRST}, 1, 6), '[^A-Za-z ]', '', 'g') as alias from documents), p as (select x.doc_id, x.alias, y.alias as other, lower(trim(regexp_replace(x.alias, ' +', ' ', 'g'), ' ')) as a,
            lower(trim(regexp_replace(y.alias, ' +', ' ', 'g'), ' ')) as b from d x join d y on y.doc_id = x.doc_id + 1)
        select doc_id, replace(a, ' ', '') = replace(b, ' ', '') as soft_same, replace(a, ' ', '') = replace(b, ' ', '') and alias <> other as soft_same_other_raw, least(levenshtein(a, b), 4)::int as edits,
            case when a = '' or b = '' then 'alias_missing' when a = b then 'same_alias' else 'different_alias' end as relation, case when a <> '' and a = b then 'same_alias_identity_continuity' else 'sockpuppet_primary' end as scope from p""",
    "style_gaps": f"""with {_SCORED}, o as (select doc_id, round(lower / greatest(chars, 1), 6) as l, round(stops / greatest(chars, 1), 6) as t, round(blanks / greatest(chars, 1), 6) as b, score from s),
        g as (select x.doc_id, x.score, case when abs(x.l - y.l) < 0.9 then round(abs(x.l - y.l), 6) end as a, case when abs(x.t - y.t) < 0.9 then round(abs(x.t - y.t), 6) end as t, case when abs(x.b - y.b) < 0.9 then round(abs(x.b - y.b), 6) end as b from o x left join o y on y.doc_id = x.doc_id + 1)
        select doc_id, round(coalesce(a, 0) + coalesce(t, 0) + coalesce(b, 0), 6) as gap_sum, ((coalesce(a, 0) >= 0.02)::int + (coalesce(t, 0) >= 0.02)::int + (coalesce(b, 0) >= 0.02)::int) as gap_hits,
            round(1 - list_median([coalesce(a, 0), coalesce(t, 0), coalesce(b, 0)]), 6) as consistency, round(abs(score - 0.75), 6) as boundary_distance, doc_id % 3 + 2 * (doc_id % 2) as clone_strength from g""",
    "signature_states": f"""with w as (select distinct source, term from {TERMS}), d as (select term, count(*) as df from w group by term), n as (select count(distinct source)::double as n from documents)
        select source, count(*) as signatures, round(avg((df / n > 0.5)::int), 6) as boilerplate_ratio, count(*) filter (df / n <= 0.1 or df = 1) as rare, round(sum(ln((n + 1) / (df + 1)) + 1), 4) as idf_sum from w join d using (term), n group by source""",
    "own_lines": """with s as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as position, unnest(string_split(text, chr(10))) as segment from documents), l as (select * from s where length(segment) >= 8),
        d as (select segment, count(distinct doc_id) as df from l group by segment), r as (select l.*, df, row_number() over (partition by doc_id order by df, position) as k from l join d using (segment))
        select doc_id, md5(string_agg(segment, ' ' order by position, segment)) as text from r where df <= (select count(*) from documents) * 0.01::double or k <= 1 group by doc_id""",
    "consistent_clusters": f"with recursive {_CONSISTENT.format(edges=_EDGE_CTES)} select id, component from good",
    "closure_candidates": f"""with recursive {_CONSISTENT.format(edges=_EDGE_CTES)}, c as (select x.id as a, y.id as b, component from good x join good y using (component) where x.id < y.id and (x.id, y.id) not in (select (a, b) from edges))
        select * from (select component, a, b, row_number() over (partition by component order by a, b)::int as rank from c) where rank <= 5""",
    "best_appearances": """select o_custkey, o_orderkey, o_totalprice, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderpriority nulls last, o_orderkey nulls last) as k from orders) where k = 1""",
    "appended_queue": "select doc_id, row_number() over (order by doc_id) + (select coalesce(max(doc_id % 100), 0) from labels where toxic = 0) as place from labels where toxic = 1",
    "pending_rows": f"""select doc_id, {' or '.join(f'(doc_id % {k + 3} = 0 or doc_id % {k + 9} = 1)' for k in range(3))} as read from labels""",
    "weighted_rows": f"""with {_SCORED}, o as (select doc_id, quality, case when doc_id % 10 <> 0 then chars::double end as size, blanks from s), m as (select avg(size) as ms, var_pop(size) * count(size) / count(*) as vs, avg(blanks) as mb, var_pop(blanks) as vb from o),
        c as (select quality, count(*) as n from o group by quality) select doc_id, round((select count(*) from o) / (2 * n), 6) as weight, round((coalesce(size, ms) - ms) / sqrt(vs), 5) as size, round((blanks - mb) / sqrt(vb), 5) as blanks from o join c using (quality), m""",
    "source_value_texts": f"""with t as {TERMS}, c as (select source, term, count(*) as n, min(doc_id) as first_seen from t group by all), k as (select *, row_number() over (partition by source order by n desc, first_seen, term) as rank from c)
        select source, string_agg(term, ' || ' order by rank) as text, first, last, words from k join (select source, min(doc_id) as first, max(doc_id) as last, count(*) as words from t group by source) using (source) where rank <= 4 group by source, first, last, words""",
    "pages_of_keys": r"""with r as (select page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^?#]+)', 1) as rest from pages), p as (select page_id, case when rest <> '' then array_to_string(list_prepend(regexp_replace(string_split(rest, '/')[1], '^www\.', ''),
            list_filter(string_split(rest, '/')[2:], lambda x: x <> '')[1:1]), '/') end as key from r), k as (select p.page_id, key, quality::varchar as note from p left join labels on doc_id = p.page_id where key in (select key from p where page_id % 9 = 0))
        select page_id, key, coalesce(note, '0') as note, concat_ws(chr(10), 'Key: ' || key, 'Note: ' || note) as section from k""",
    "boundary_reviews": f"""with {_SCORED}, b as (select doc_id, case doc_id % 3 when 0 then 'p' when 1 then 'n' end as bucket, doc_id % 2 > 0 as kept, doc_id % 17 = 0 as anchor, score + 0.15 as sem, score, score + 0.05 as cat, (doc_id % 4) * score as gap, doc_id % 3 as clone from s),
        r as (select doc_id, case when anchor then 1 when bucket = 'p' and kept and sem >= 0.9 and score >= 0.7 and cat >= 0.75 and gap <= 1.2 and clone >= 1 then 2 when bucket = 'n' and not kept and sem >= 0.75 and gap >= 2.2 then 3
            when not kept and sem >= 0.8 and gap >= 2.7 then 4 else 0 end as rule from b)
        select doc_id, case when rule = 1 then 'positive' when rule in (3, 4) then 'negative' else 'uncertain' end as label, case rule when 1 then 'direct_identifier_anchor' when 2 then 'strong_overlap_without_identity_anchor'
            when 3 then 'high_semantic_high_style_gap_negative' when 4 then 'unsupported_high_style_gap_negative' else 'insufficient_identity_closure' end as reason, rule from r""",
    "anchor_reviews": rf"""with c as (select doc_id, ['wechat', 'external_url', 'qq', 'bat', 'fax', 'telegram'][doc_id % 6 + 1] as kind, ['store', 'x.org', '12345', 'support', 'a_shop'][(doc_id // 6) % 5 + 1] as token,
            [{', '.join(f"'{c}'" for c in CONTEXTS)}][(doc_id // 30) % 5 + 1] as x from labels),
        a as (select doc_id, x, case when doc_id % 13 = 0 then 1 when doc_id % 7 = 0 then 2 when token in ('store', 'support') then 3 when kind = 'external_url' then 4 when kind in ('wechat', 'telegram') and contains(x, 'youtube.com/watch') then 5
            when kind in ('wechat', 'telegram', 'qq', 'bat') then 6 else 0 end as r, case when doc_id % 4 = 0 and (contains(x, '微信') or contains(x, ' tg')) then 1 when doc_id % 5 = 0 then 2 when regexp_matches(x, '(?i)(数据格式|mega)') then 3 else 0 end as t from c)
        select doc_id, case when r in (3, 5) then 'negative' when r = 6 then 'positive' else 'uncertain' end as anchor_label, ['unsupported_anchor_type', 'product_or_victim_data_risk', 'weak_or_one_sided_seller_contact_context', 'generic_parser_token',
            'support_only_external_url', 'public_media_id_not_seller_identity', 'shared_seller_facing_direct_identifier'][r + 1] as anchor_reason, case when t = 1 then 'positive' else 'uncertain' end as targeted_label,
            ['model_high_score_without_identity_anchor', 'seller_facing_shared_direct_contact', 'proof_anchor_neighbor_no_independent_direct_identity', 'product_or_template_overlap_no_identity_anchor'][t + 1] as targeted_reason from a""",
    "source_reviews": """with f as (select doc_id, doc_id % 4 as b, (doc_id // 4) % 5 as t, (doc_id // 20) % 4 as d, doc_id % 19 = 0 as f_soft, doc_id % 23 = 0 as f_print, (doc_id // 5) % 4 = 1 as f_contact, (doc_id // 6) % 2 = 1 as f_email, (doc_id // 7) % 3 = 1 as f_direct, (doc_id // 8) % 4 = 1 as f_facing, (doc_id // 9) % 2 = 1 as f_goods, (doc_id // 10) % 3 = 1 as f_template, (doc_id // 11) % 4 = 1 as f_specific, (doc_id // 12) % 2 = 1 as f_support, (doc_id // 13) % 3 = 1 as f_alias_related, (doc_id // 14) % 4 = 1 as f_placeholder from documents),
        r as (select doc_id, case when f_soft then 1 when f_print then 2
            when b = 0 then case when not f_contact then 3 when f_goods and not f_facing then 4 when f_direct and f_facing and f_support then 5 when f_email and f_facing and f_support and not f_goods then 6 when f_email and f_goods then 7 else 8 end
            when b = 1 then case when t >= 2 and d >= 1 and f_alias_related and not (f_template or f_goods) then 9 when t >= 3 and d >= 2 and f_specific and not (f_template or f_goods) then 10 when (f_template or f_goods) and not f_specific then 11 else 12 end
            when b = 2 then case when f_contact then 13 when f_placeholder then 14 when f_template or f_goods then 15 when not f_alias_related then 16 else 17 end else 0 end as source_rule from f),
        g as (select doc_id, doc_id % 6 as b, (doc_id // 6) % 6 as k, (doc_id % 16) / 100 as lex, (doc_id % 11) / 20 as st, doc_id % 29 = 0 as clone, (doc_id // 5) % 3 = 0 as sure, (doc_id // 7) % 3 = 0 as facing, (doc_id // 11) % 3 = 0 as victim,
            (doc_id // 13) % 3 = 0 as wallet, (doc_id // 17) % 3 = 0 as purl, (doc_id // 2) % 3 = 0 as ourl from documents),
        h as (select *, clone or lex >= 0.05 or st >= 0.2 as support, clone or lex >= 0.14 or st >= 0.5 as strong from g),
        a as (select doc_id, case b when 0 then 1 when 1 then case when victim and not facing then 2 when k in (0, 4) and sure and facing and support then 3 when k = 1 and wallet and strong then 4 when k = 2 and facing and not victim and strong then 5 when k = 2 then 6 else 7 end
            when 2 then case when victim or purl then 8 when ourl and strong and k <> 5 then 9 else 10 end when 3 then case when strong and not victim then 11 else 12 end
            when 4 then case when k = 4 then 13 when k = 2 then 14 when k = 0 and (clone or lex >= 0.1 or st >= 0.35) then 15 else 16 end else 0 end as anchor_rule from h)
        select doc_id, case when source_rule in (2, 5, 6, 9, 10) then 'positive' when source_rule in (14, 15, 16) then 'negative' else 'uncertain' end as source_label, source_rule,
            case when anchor_rule in (1, 3, 4, 5, 9, 11, 15) then 'positive' when anchor_rule = 13 then 'negative' else 'uncertain' end as anchor_label, anchor_rule from r join a using (doc_id)""",
}
