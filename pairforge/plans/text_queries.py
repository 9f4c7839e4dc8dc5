"""Queries over texts, pages and entity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import numeric, text
from pairforge.operators import block, profile, signals
from pairforge.plans.tables import table

#: A value that more ids share than this pairs nothing: it says nothing about any two of them.
MOST_SHARED = 50


def clone_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value): the digest of each document's signature, as far as it has one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.signature(F.col("text")).alias("s"))
    return docs.filter(F.length("s") > 0).select("id", F.md5("s").alias("value"))


SIGNATURES = "(select doc_id as id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) as value from documents where regexp_matches(lower(text), '[a-z0-9]'))"


def doc_clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with equal signatures, with the Jaccard overlap of their distinct words."""
    pairs = block.pairs_by_value(clone_signatures(spark, sf_dir), most=MOST_SHARED)
    bags = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))).alias("bag"))
    here = bags.join(pairs.select(F.explode(F.array("left", "right")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    for side in ("left", "right"):
        pairs = pairs.join(here.select(F.col("doc_id").alias(side), F.col("bag").alias(f"{side}_bag")), side)
    return pairs.select("left", "right", "group_size", F.round(numeric.jaccard(F.col("left_bag"), F.col("right_bag")), 6).alias("overlap"))


PAIRS = f"""with s as {SIGNATURES}, g as (select value, count(*) as group_size from s group by value having count(*) between 2 and {MOST_SHARED}),
p as (select a.id as "left", b.id as "right", group_size from s a join g using (value) join s b using (value) where a.id < b.id)"""


def doc_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: their size, ids' range and the sources they come from."""
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest"))
    return docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("source").alias("sources")).filter("n > 1 and digest is not null")


def hot_value_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by first word and language together, groups of 2 to 20 documents only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.get(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")), F.lit(0)).alias("value")).filter("value is not null")
    return block.pairs_by_value(docs, ["lang", "value"], most=20)


# Texts with Han characters, marks and widths that the tables lack; ids below 0.
HAN_TEXTS = [
    (-1, "飞机号：@shop_one 长期供应，质量保证！\n联系 12345678 或 Email a@b.org；数据 ABC-12", "zh"),
    (-2, "在线 48 小时 好评∶风险 12∶3 价格 1,234 元", "zh"),
    (-3, "全新正品 现货秒发 支持退款 全新正品", "zh"),
    (-4, "ＡＢＣ１２３ ﬁne ² Straße ÉCOLE", "xx"),
    (-5, "", "xx"),
    (-6, "繁體字與簡體字 mixed Text 2024", "zh"),
]


def texts_with_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang) of all documents and of the fixed texts."""
    fixed = spark.createDataFrame(HAN_TEXTS, "doc_id bigint, text string, lang string")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").unionByName(fixed)


def _values(rows: list[tuple]) -> str:
    one = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


WITH_HAN = f"(select doc_id, text, lang from documents union all select * from {_values(HAN_TEXTS)} v(doc_id, text, lang))"


def doc_style_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style of each text, its first line as the title and the rest as the description."""
    own = texts_with_han(spark, sf_dir)
    rest = F.when(F.contains("text", F.lit("\n")), F.substring("text", F.instr("text", "\n") + 1, F.length("text"))).otherwise("")
    docs = own.select("doc_id", text.style(F.substring_index("text", "\n", 1), rest).alias("s"))
    return docs.select("doc_id", "s.*")


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of each text, whole and as it is, hours online, and counts of good and risk."""
    own = texts_with_han(spark, sf_dir).select("doc_id", "text").unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 10_000_000).alias("doc_id"), F.regexp_replace("url", "/", " -").alias("text")))
    good = text.good_and_risk(F.col("text"))
    return own.select("doc_id", text.first_number(F.col("text")).alias("number"), text.first_whole(F.col("text")).alias("whole"), text.hours(F.col("text")).alias("hours"), good["good"].alias("good"), good["risk"].alias("risk"))


def signature_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's signature as a digest, and its Han characters by the three ranges."""
    own = texts_with_han(spark, sf_dir)
    counts = {"han": text.HAN_BASIC, "han_extended": text.HAN_BMP, "han_all": text.HAN_ALL}
    return own.select("doc_id", F.md5(text.signature(F.col("text"))).alias("signature"), *(text.han_count(F.col("text"), r).alias(n) for n, r in counts.items()))


def source_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's five most frequent titles (first lines of up to 40 characters)."""
    title = F.substring(F.trim(F.substring_index("text", "\n", 1)), 1, 40)
    docs = table(spark, sf_dir, "documents").select("source", title.alias("title"), "doc_id")
    return profile.top_values(profile.value_counts(docs, ["source"], "title", "doc_id"), ["source"], 5)


def source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, term, doc_id): every Latin word of every text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("source", F.explode(text.words(F.col("text"))).alias("term"), "doc_id")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


TERMS = f"(select source, t as term, doc_id from (select source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,23}}')) as t from documents) where t not in ({_STOP}))"


def signature_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's eight most specific words."""
    counts = profile.value_counts(source_terms(spark, sf_dir), ["source"], "term", "doc_id")
    n = table(spark, sf_dir, "documents").select("source").distinct().count()
    out = profile.signature_values(counts, ["source"], F.lit(n), 8)
    return out.select("source", F.col("value").alias("term"), "count", "first_seen", "entity_df", F.round("specificity", 6).alias("specificity"), "rank")


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(text.words(F.col("text"))).alias("term"))
    return docs.groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf_topterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest words of each document among those that 2 to 200 documents have."""
    n = table(spark, sf_dir, "documents").count()
    return profile.term_weights(doc_terms(spark, sf_dir), "id", n, 10, most_df=200).withColumn("weight", F.round("weight", 6))


def lexical_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most alike later documents of each document, by cosine of the 20 heaviest words."""
    n = table(spark, sf_dir, "documents").count()
    weights = profile.term_weights(doc_terms(spark, sf_dir), "id", n, 20, most_df=100)
    return block.sparse_neighbours(weights, "id", least=0.3, k=5)


def _weights(k: int, most: int) -> str:
    return f"""t as (select doc_id as id, w as term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,23}}')) as w from documents)
    where w not in ({_STOP}) group by all), n as (select count(*)::double as n from documents),
d as (select term, count(*) as df from t group by term having count(*) >= 2 and count(*) <= least((select n from n) * 0.5, {most})),
w as (select id, term, round((1 + ln(1 + tf)) * (ln(((select n from n) + 1) / (df + 1)) + 1), 9) as weight from t join d using (term)),
k as (select * from (select *, row_number() over (partition by id order by weight desc, term) as rank from w) where rank <= {k})"""


def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of all kinds in documents, conversations and the fixed texts: kind, normal form, and the number of texts with it."""
    docs = texts_with_han(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "conversations").select("text")).unionByName(spark.createDataFrame([(t,) for t in CONTACT_TEXTS], "text string"))
    found = docs.select(F.explode(text.contacts(F.col("text"))).alias("c")).select("c.kind", text.contact_key(F.col("c.kind"), F.col("c.raw")).alias("value"))
    return found.filter("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


# Texts with contacts of kinds that the tables lack.
CONTACT_TEXTS = ["write to telegram: @Some_Shop or t.me/other_shop", "Wickr me: Fast.Shop-1, wechat: good_shop9", "QQ: 12345678 or +49 (30) 1234-5678", "qq 123 telegram: abc", "-----BEGIN PGP BLOCK-----\nx@y.org\n-----END PGP BLOCK----- z@y.org"]


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.url_key(F.col("url")).alias("url_key"))


def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("visible"))
    return pages.select("page_id", F.length("visible").alias("chars"), F.md5("visible").alias("digest"))


def shared_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents by rare words: 12 characters or more, in 2 to 6 documents; with the number they share."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{12,})")))).alias("value"))
    return block.pairs_by_value(docs, most=6).groupBy("left", "right").agg(F.count("*").alias("shared"))


#: Words in a row that a document and a benchmark text share if one quotes the other.
QUOTED_WORDS = 13


def leakage_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first reason to keep them out: equal to a benchmark text, quoting one, too short."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    quotes = block.quoting(docs, "doc_id", "text", known, "text", words=QUOTED_WORDS).withColumn("quotes", F.lit(True))
    same = known.select(F.md5(text.spaced(F.col("text"))).alias("digest")).distinct().withColumn("same", F.lit(True))
    marked = docs.select("doc_id", F.md5(text.spaced(F.col("text"))).alias("digest"), F.length("text").alias("chars")).join(same, "digest", "left").join(quotes, "doc_id", "left")
    reason = F.when(F.col("same"), "same").when(F.col("quotes"), "quoting").when(F.coalesce("chars", F.lit(0)) < 200, "short").otherwise("keep")
    return marked.select("doc_id", reason.alias("status"))


def leakage_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two sources share: a row for each pair of sources with any."""
    from pairforge.sources.checks import overlaps

    docs = table(spark, sf_dir, "documents").select("source", F.md5(text.spaced(F.col("text"))).alias("k"))
    return overlaps(docs, "source", "k")


def signal_context_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity signals of documents with the text around them."""
    return signals.extract_signals(table(spark, sf_dir, "documents"), "source", "doc_id", ["text"])


def segment_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's lines by the share of sources that have them: lines, distinct lines, lines of half of all sources."""
    docs = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 8)
    counts = docs.groupBy("source", "line").agg(F.count("*").alias("n"))
    df = counts.groupBy("line").agg(F.count("*").alias("df"))
    n = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("all"))
    return counts.join(df, "line").join(F.broadcast(n), F.lit(True)).groupBy("source").agg(
        F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"), F.count_if(F.col("df") * 2 >= F.col("all")).alias("boilerplate_lines"), F.count_if(F.col("df") == 1).alias("own_lines")
    )


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable keys of items and of the pair of an item and the one before it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.stable_id("item_", F.col("source"), F.col("doc_id")).alias("item_uid"), text.pair_key(F.col("doc_id"), F.col("doc_id") - 1).alias("pair_uid"))


def script_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of texts by language: Han, letters of Latin, bigrams of words, distinct runs of two and three Han characters."""
    docs = texts_with_han(spark, sf_dir)
    bigrams = F.size(F.array_distinct(text.word_pairs(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")))))
    grams = F.size(F.array_distinct(text.han_grams(F.col("text"))))
    return docs.groupBy("lang").agg(F.sum(text.han_count(F.col("text"))).cast("bigint").alias("han"), F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))).cast("bigint").alias("latin"), F.sum(bigrams).alias("bigrams"), F.sum(grams).alias("han_grams"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_clone_pairs, doc_exact_groups, hot_value_blocking, doc_style_metrics, parsed_numbers, signature_forms, source_profile_topk, signature_terms, tfidf_topterms, lexical_neighbors, contact_extract, url_normalize,
        html_visible_text, shared_token_pairs, leakage_exclusion, leakage_overlap_check, signal_context_udtf, segment_boilerplate, stable_ids, script_mix,
    )
}

_COUNT = "len(regexp_extract_all"
_BLANK = r"\p{Z}\t-\r\x1c-\x1f\x{85}"
_WHITE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CLEAN = f"trim(regexp_replace({{}}, '{_WHITE.replace('{', '{{').replace('}', '}}')}', ' ', 'g'), ' ')"
_SPACED = f"lower(trim(regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g'), ' '))"

ORACLE = {
    "doc_clone_pairs": f"""{PAIRS}, b as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as bag from documents)
        select "left", "right", group_size, round(len(list_intersect(x.bag, y.bag)) / len(list_distinct(list_concat(x.bag, y.bag))), 6) as overlap
        from p join b x on x.doc_id = "left" join b y on y.doc_id = "right" """,
    "doc_exact_groups": "select md5(text) as digest, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id, count(distinct source) as sources from documents where text is not null group by 1 having count(*) > 1",
    "hot_value_blocking": """with v as (select distinct doc_id as id, lang, regexp_extract_all(lower(text), '[a-z0-9]+')[1] as value from documents where regexp_matches(lower(text), '[a-z0-9]')),
        g as (select lang, value, count(*) as group_size from v group by all having count(*) between 2 and 20)
        select a.id as "left", b.id as "right", lang, value, group_size from v a join g using (lang, value) join v b using (lang, value) where a.id < b.id""",
    "doc_style_metrics": rf"""with d as (select doc_id, string_split(text, chr(10))[1] as title, case when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) else '' end as rest from {WITH_HAN}),
        b as (select doc_id, title, rest, title || ' ' || rest as t from d), n as (select *, {_COUNT}(t, '[^{_BLANK}]')) as visible, {_COUNT}(t, '\p{{L}}')) as letters from b),
        l as (select *, {_CLEAN.format('title')} as ct, {_CLEAN.format('rest')} as cr from n)
        select doc_id, length(ct)::int as title_length, length(cr)::int as description_length, coalesce(round({_COUNT}(t, '\p{{Nd}}')) / nullif(visible, 0), 6), 0) as digits,
            coalesce(round({_COUNT}(t, '[^{_BLANK}\p{{L}}\p{{N}}]')) / nullif(visible, 0), 6), 0) as punctuation, coalesce(round({_COUNT}(t, '\p{{Lu}}')) / nullif(letters, 0), 6), 0) as upper,
            {_COUNT}(t, '\n'))::int as line_ends from l""",
    "parsed_numbers": rf"""with d as (select doc_id, text from {WITH_HAN} union all select page_id + 10000000, replace(url, '/', ' -') from pages),
        n as (select *, try_cast(replace(regexp_extract(text, '([-+]?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') as double) as number from d)
        select doc_id, number, trunc(number)::bigint as whole, coalesce(try_cast(regexp_extract(text, '([0-9]+)[\s]*小时', 1) as bigint), trunc(number)::bigint) as hours,
            try_cast(regexp_extract(text, '([0-9]+)\s*[∶:]\s*([0-9]+)', 1) as bigint) as good, try_cast(regexp_extract(text, '([0-9]+)\s*[∶:]\s*([0-9]+)', 2) as bigint) as risk from n""",
    "signature_forms": rf"""select doc_id, md5(case when regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') then regexp_replace(lower(text), '[^0-9A-Za-z\x{{4e00}}-\x{{9fff}}]+', '', 'g') else array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') end) as signature,
        {_COUNT}(text, '[\x{{4e00}}-\x{{9fff}}]'))::int as han, {_COUNT}(text, '[\x{{3400}}-\x{{9fff}}]'))::int as han_extended, {_COUNT}(text, '[\x{{3400}}-\x{{9fff}}\x{{20000}}-\x{{323AF}}]'))::int as han_all from {WITH_HAN}""",
    "source_profile_topk": """with t as (select source, substr(trim(string_split(text, chr(10))[1], ' '), 1, 40) as value, doc_id from documents),
        c as (select source, value, count(*) as count, min(doc_id) as first_seen from t where trim(value, ' ') <> '' group by all)
        select * from (select *, row_number() over (partition by source order by count desc, first_seen, value)::int as rank from c) where rank <= 5""",
    "signature_terms": f"""with t as {TERMS}, c as (select source, term, count(*) as count, min(doc_id) as first_seen from t group by all), d as (select term, count(*) as entity_df from c group by term),
        n as (select count(distinct source)::double as n from documents), s as (select c.*, entity_df, ln(1 + count) * (ln(((select n from n) + 1) / (entity_df + 1)) + 1) as x from c join d using (term))
        select source, term, count, first_seen, entity_df, round(x, 6) as specificity, rank from (select *, row_number() over (partition by source order by round(x, 9) desc, count desc, first_seen desc, term)::int as rank from s) where rank <= 8""",
    "tfidf_topterms": f"with {_weights(10, 200)} select id, term, round(weight, 6) as weight, rank::int as rank from k",
    "lexical_neighbors": f"""with {_weights(20, 100)}, m as (select id, sqrt(sum(weight * weight)) as norm from k group by id),
        p as (select a.id as "left", b.id as "right", sum(a.weight * b.weight) as dot from k a join k b on a.term = b.term and a.id < b.id group by all),
        s as (select "left", "right", round(dot / (x.norm * y.norm), 6) as cosine from p join m x on x.id = "left" join m y on y.id = "right")
        select * from (select *, row_number() over (partition by "left" order by cosine desc, "right")::int as rank from s where cosine >= 0.3) where rank <= 5""",
    "contact_extract": f"""with t as (select row_number() over () as r, regexp_replace(text, '(?s)-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----', ' ', 'g') as text
            from (select text from {WITH_HAN} union all select text from conversations union all select * from {_values([(t,) for t in CONTACT_TEXTS])} v(text))),
        f as ({' union all '.join(f"select distinct r, '{k}' as kind, unnest(regexp_extract_all(text, '{p}')) as raw from t" for k, p in text.CONTACTS.items())}),
        v as (select kind, case when kind = 'email' then lower(trim(raw, ' ')) when kind in ('phone', 'qq') then regexp_replace(raw, '[^0-9]', '', 'g') else lower(regexp_replace(raw, '(?i)^.*(?:t\\.me/|[: ]+)@?|^@', '')) end as value from f)
        select kind, value, count(*) as n from v where kind = 'email' or kind = 'phone' and length(value) >= 7 or kind = 'qq' and length(value) between 5 and 12 or kind not in ('email', 'phone', 'qq') and length(value) >= 3 group by all""",
    "url_normalize": r"""with r as (select page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^?#]+)', 1) as rest from pages),
        p as (select page_id, rest, regexp_replace(string_split(rest, '/')[1], '^www\.', '') as host, list_filter(string_split(rest, '/')[2:], lambda x: x <> '')[1:2] as parts from r)
        select page_id, case when rest <> '' then array_to_string(list_prepend(host, parts), '/') end as url_key from p""",
    "html_visible_text": r"""with a as (select page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') as h from pages),
        b as (select page_id, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') as visible from a)
        select page_id, length(visible)::int as chars, md5(visible) as digest from b""",
    "shared_token_pairs": """with v as (select distinct doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{12,}')) as value from documents),
        g as (select value from v group by value having count(*) between 2 and 6)
        select a.id as "left", b.id as "right", count(*) as shared from v a join g using (value) join v b using (value) where a.id < b.id group by all""",
    "leakage_exclusion": rf"""with d as (select doc_id, length(text) as chars, {_SPACED} as t from documents), k as (select {_SPACED} as t from benchmark),
        w as (select doc_id, string_split(t, ' ') as w from d where t <> ''), kw as (select string_split(t, ' ') as w from k where t <> ''),
        g as (select distinct unnest(list_transform(generate_series(1, len(w) - {QUOTED_WORDS - 1}), lambda i: array_to_string(w[i:i + {QUOTED_WORDS - 1}], ' '))) as g from kw where len(w) >= {QUOTED_WORDS}),
        e as (select doc_id, unnest(list_transform(generate_series(1, len(w) - {QUOTED_WORDS - 1}), lambda i: array_to_string(w[i:i + {QUOTED_WORDS - 1}], ' '))) as g from w where len(w) >= {QUOTED_WORDS}),
        q as (select distinct doc_id from e semi join g using (g))
        select doc_id, case when t in (select t from k) then 'same' when doc_id in (select doc_id from q) then 'quoting' when coalesce(chars, 0) < 200 then 'short' else 'keep' end as status from d""",
    "leakage_overlap_check": rf"""with k as (select distinct source, {_SPACED} as k from documents where text is not null)
        select a.source as split_a, b.source as split_b, count(*) as shared from k a join k b using (k) where a.source < b.source group by all""",
    "segment_boilerplate": """with c as (select source, line, count(*) as n from (select source, unnest(string_split(text, chr(10))) as line from documents) where length(line) >= 8 group by all),
        d as (select line, count(*) as df from c group by line) select source, sum(n)::bigint as lines, count(*) as distinct_lines,
        count(*) filter (df * 2 >= (select count(distinct source) from documents)) as boilerplate_lines, count(*) filter (df = 1) as own_lines from c join d using (line) group by source""",
    "stable_ids": """select doc_id, 'item_' || sha1(coalesce(source, '') || chr(31) || doc_id) as item_uid,
        least(doc_id::varchar, (doc_id - 1)::varchar) || '||' || greatest(doc_id::varchar, (doc_id - 1)::varchar) as pair_uid from documents""",
    "script_mix": rf"""with w as (select lang, text, regexp_extract_all(lower(text), '[a-z0-9]+') as w, regexp_extract_all(text, '[\x{{3400}}-\x{{9fff}}]{{2,}}') as s from {WITH_HAN}),
        g as (select *, list_distinct(flatten(list_transform(s, lambda x: list_concat(list_transform(generate_series(1, length(x) - 1), lambda i: substr(x, i, 2)), list_transform(generate_series(1, length(x) - 2), lambda i: substr(x, i, 3)))))) as grams from w)
        select lang, sum({_COUNT}(text, '[\x{{4e00}}-\x{{9fff}}]')))::bigint as han, sum(len(regexp_extract_all(text, '[A-Za-z]')))::bigint as latin,
        sum(case when len(w) > 1 then len(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) else 0 end)::bigint as bigrams, sum(len(grams))::bigint as han_grams from g group by lang""",
}
