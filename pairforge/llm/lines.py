"""Line dedup by site-relative frequency.

For each host the pages that hold a line are divided by all pages of the host; lines above a ratio are boilerplate
and are dropped from the host's pages. Only DataFrame functions run. Lines are compared without blanks at their ends.

Defined cases: a null host is a host of its own; null and empty texts have no lines, count as pages and stay as they
are; blank lines are never boilerplate; a line counts once for each page; rows that repeat are pages of their own; a
page all of whose non-blank lines are boilerplate is a copy of other pages, not a frame around a text: it stays as it
is, for a later stage to decide. An empty table gives an empty table. A column of the input named like the added
n_dropped is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.shared import stash


def _key(line: Column) -> Column:
    """Stands for a line in the counts: two hashes of 64 bits each."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("n"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def drop_boilerplate(docs: DataFrame, *, ratio: float = 0.02, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, and n_dropped, the number of dropped lines.

    A line is boilerplate for a host if more than ``ratio`` of its pages, and more than one page, hold it: what only one
    page holds is not repeated, however few pages the host has.

    Lines go through the shuffle as hashes, counted per partition first, so that a hot host or line adds few rows.
    Texts move only once, beside the few lines of them that are boilerplate.
    """
    own = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    pages = own.groupBy("host").agg(F.count("*").alias("pages"))
    each = own.filter(F.length("text") > 0).select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x != ""))).alias("line"))
    counts = each.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("with_line")).filter("with_line > 1")
    found = counts.join(pages, counts["host"].eqNullSafe(pages["host"])).filter(F.col("with_line") > F.col("pages") * ratio)
    flagged = stash(found.select(counts["host"].alias("host"), F.col("key.h").alias("h"), F.col("key.n").alias("n")), "lines")

    row = F.struct(F.xxhash64(host, text).alias("a"), F.xxhash64(text, host).alias("b"))
    lines = docs.filter(F.length(text) > 0).select(F.col(host).alias("host"), row.alias("row"), F.explode(F.array_distinct(F.filter(_lines(F.col(text)), lambda x: x != ""))).alias("line"))
    lines = lines.select("host", "row", _key(F.col("line")).alias("key")).select("host", "row", "key.h", "key.n")
    # pages with equal host and text have equal lines: one set of them is enough
    here = lines.join(flagged, lines["host"].eqNullSafe(flagged["host"]) & (lines["h"] == flagged["h"]) & (lines["n"] == flagged["n"]), "left_semi")
    bad = here.groupBy(F.col("row").alias("_line_row")).agg(F.collect_set(F.struct("h", "n")).alias("_line_bad"))

    table = docs.drop("n_dropped")
    joined = table.withColumn("_line_key", row).join(bad, F.col("_line_key") == F.col("_line_row"), "left")
    split = F.split(F.col(text), "\n")
    keep = F.filter(split, lambda x: ~F.array_contains(F.col("_line_bad"), _key(F.trim(x))))
    some = F.exists(keep, lambda x: F.trim(x) != "")
    cut = F.col("_line_bad").isNotNull() & some
    out = joined.withColumn("_line_cut", F.when(cut, keep))
    out = out.withColumn("n_dropped", F.coalesce(F.size(F.split(F.col(text), "\n")) - F.size("_line_cut"), F.lit(0)))
    out = out.withColumn(text, F.when(F.col("_line_cut").isNotNull(), F.array_join("_line_cut", "\n")).otherwise(F.col(text)))
    return out.drop("_line_key", "_line_row", "_line_bad", "_line_cut")


def oracle(ratio: float = 0.02) -> str:
    """The same for ``documents`` in DuckDB's SQL."""
    return f"""
    with l as (select row_number() over () as r, *, string_split(text, chr(10)) as lines from documents),
    e as (select distinct r, source, trim(x) as line from (select r, source, unnest(lines) as x from l) where trim(x) <> ''),
    p as (select source, count(*) as pages from documents group by source),
    f as (select e.source, line from e join p on e.source is not distinct from p.source group by e.source, line, pages
        having count(*) > 1 and count(*) > pages * {ratio}),
    g as (select r, list(e.line) as bad from e join f on e.source is not distinct from f.source and e.line = f.line group by r),
    k as (select l.*, case when bad is not null then list_filter(lines, lambda x: not list_contains(bad, trim(x))) end as kept from l left join g using (r)),
    c as (select *, case when len(list_filter(kept, lambda x: trim(x) <> '')) > 0 then kept end as cut from k)
    select doc_id, case when cut is null then text else array_to_string(cut, chr(10)) end as text, lang, source, n_chars,
        coalesce(len(lines) - len(cut), 0)::int as n_dropped from c
    """
