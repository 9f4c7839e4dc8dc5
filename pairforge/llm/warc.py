"""WARC records: reading archives, and resolving not-modified revisits to the full responses they stand for.

A revisit with the profile server-not-modified says that a capture equalled one that the client had: the server answered
304. Revisits of other profiles, such as those of identical payloads, have full headers of their own and are none of
these. A not-modified revisit is resolved by an as-of join: among full responses of the same canonical URL, the latest that is strictly earlier; of several at
that second, the one with the greatest record id. Then validators are checked: if the revisit names an ETag, it must
equal that of the response by weak comparison; otherwise, if it names a Last-Modified, that must be equal. Without
either the earlier response is taken unchecked. Headers that a 304 answer may update replace the stored ones; all
others stay.

The join does not gather a URL's records in one task: each hour of a URL is a group of its own, and what an hour takes
over from earlier ones comes from a running maximum over hours, one row each.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The header fields that a 304 answer may update, in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a group of records of one URL.
SPAN = 3600
# The end of the profile's address of a not-modified revisit, in any version of the format.
NOT_MODIFIED = r"(?i)/revisit/server-not-modified/?$"
# Query parameters that only track where a visitor came from.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref|sessionid)="


def canonical_url(url: Column) -> Column:
    """A URL's key: no scheme, fragment, default port, "www.", tracking parameters or last slash; host in lower case, parameters sorted.

    Null and what has no scheme and host stay as they are.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host == "", url).otherwise(F.concat(host, path, tail))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each not-modified revisit among ``records``.

    ``records`` has record_id (long), url, time (long, seconds), kind ("response" or "revisit"), status (int),
    headers (map of lower-case names to values), digest and, if there is one, profile. Full responses are those of kind
    "response" with status 200. Not-modified revisits have that profile and the status 304 or none, or no profile and
    the status 304; all other revisits are passed over. Returns record_id, url_key, time, state ("resolved", "mismatch" or "missing"), refers_to, refers_time, digest
    and headers (merged if resolved, else the revisit's own).

    Defined cases: rows with null url, time, kind or record_id are passed over; null headers count as none; rows that
    repeat are resolved each; other columns are not read. An empty table gives an empty result.
    """
    profile = F.col("profile").cast("string") if "profile" in records.columns else F.lit(None).cast("string")
    named = F.when(profile.isNull(), F.col("status") == 304).otherwise(profile.rlike(NOT_MODIFIED) & (F.coalesce("status", F.lit(304)) == 304))
    records = records.withColumn("kind", F.when((F.col("kind") != "revisit") | named, F.col("kind")))
    own = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("bigint").alias("time"), "kind", "status", F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"), "digest")
    own = own.dropna(subset=["record_id", "url_key", "time", "kind"]).withColumn("span", F.floor(F.col("time") / SPAN))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    response = F.when(full, F.struct("time", "record_id", "digest", F.to_json("headers").alias("headers")))
    own = own.filter(full | (F.col("kind") == "revisit")).withColumn("response", response)
    last = own.groupBy("url_key", "span").agg(F.max("response").alias("last"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.withColumn("earlier", F.max("last").over(before)).select(F.col("url_key").alias("_key"), F.col("span").alias("_span"), "earlier")
    within = Window.partitionBy("url_key", "span").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("here", F.max("response").over(within)).filter(F.col("kind") == "revisit")
    found = placed.join(taken.filter("earlier is not null"), (F.col("url_key") == F.col("_key")) & (F.col("span") == F.col("_span")), "left")
    found = found.withColumn("of", F.coalesce("here", "earlier"))
    stored = F.from_json("of.headers", "map<string,string>")
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    same = F.when(etag.isNotNull(), weak(etag).eqNullSafe(weak(stored["etag"]))).when(modified.isNotNull(), modified.eqNullSafe(stored["last-modified"])).otherwise(F.lit(True))
    state = F.when(F.col("of").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    out = found.withColumn("state", state)
    good = F.col("state") == "resolved"
    return out.select(
        "record_id", "url_key", "time", "state", F.when(good, F.col("of.record_id")).alias("refers_to"), F.when(good, F.col("of.time")).alias("refers_time"),
        F.when(good, F.col("of.digest")).alias("digest"), F.when(good, merged).otherwise(F.col("headers")).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl of ``pages``: each page is a full response, fetched again a day and two days later.

    Times follow from page_id. The second fetch is a not-modified revisit with the page's ETag, made of its URL and its
    whole html, weak on odd pages; the third names a Last-Modified only, on every fifth page one that doesn't fit, and
    is on every eleventh page a revisit of an identical payload, with status 200. Every seventh page has the revisits
    before its response. Pages without url or page_id give no records, null html counts as empty.
    """
    base = pages.filter("url is not null and page_id is not null").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    start = F.lit(1_700_000_000) + F.col("page_id") * 97
    odd, fifth, seventh = F.col("page_id") % 2 == 1, F.col("page_id") % 5 == 0, F.col("page_id") % 7 == 0
    day = F.when(seventh, F.lit(-86_400)).otherwise(F.lit(86_400))
    tag = F.concat(F.lit('"'), F.md5(F.concat(F.col("url"), F.lit(" "), F.col("html"))), F.lit('"'))
    stamp = lambda t: t.cast("string")
    pairs = lambda *p: F.map_from_arrays(F.array(*(F.lit(k) for k, _ in p)), F.array(*(v for _, v in p)))
    first = pairs(("content-type", F.lit("text/html")), ("content-length", F.length("html").cast("string")), ("etag", tag), ("last-modified", stamp(start - 1000)), ("cache-control", F.lit("max-age=60")))
    second = pairs(("etag", F.when(odd, F.concat(F.lit("W/"), tag)).otherwise(tag)), ("date", stamp(start + day)), ("cache-control", F.lit("max-age=3600")), ("content-length", F.lit("0")))
    third = pairs(("last-modified", stamp(start - F.when(fifth, F.lit(1)).otherwise(F.lit(1000)))), ("date", stamp(start + 2 * day)), ("server", F.lit("x")))
    none, eleventh = F.lit(None).cast("string"), F.col("page_id") % 11 == 0
    address = "http://netpreserve.org/warc/1.1/revisit/"
    kept, same = F.lit(address + "server-not-modified"), F.lit(address + "identical-payload-digest")

    def record(k, t, kind, status, headers, digest, profile):
        return F.struct(
            (F.col("page_id") * 3 + k).alias("record_id"), "url", t.cast("bigint").alias("time"), F.lit(kind).alias("kind"), status.alias("status"), headers.alias("headers"), digest.alias("digest"), profile.alias("profile")
        )

    all_ = F.array(
        record(0, start, "response", F.lit(200), first, F.sha1("html"), none),
        record(1, start + day, "revisit", F.lit(304), second, none, kept),
        record(2, start + 2 * day, "revisit", F.when(eleventh, 200).otherwise(304), third, none, F.when(eleventh, same).otherwise(kept)),
    )
    return base.select(F.explode(all_).alias("r")).select("r.*")


def page_revisits(pages: DataFrame) -> DataFrame:
    """The revisits of the crawl of ``pages``, resolved, with headers as one string "name=value;..." in name order."""
    out = resolve_revisits(page_records(pages))
    names = F.array_sort(F.map_keys("headers"))
    return out.withColumn("headers", F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.col("headers")[k])), ";"))


#: The same for ``pages`` in DuckDB's SQL.
ORACLE = r"""
with p as (select page_id, url, coalesce(html, '') as html, 1700000000 + page_id * 97 as start, case when page_id % 7 = 0 then -86400 else 86400 end as day,
    '"' || md5(url || ' ' || coalesce(html, '')) || '"' as tag from pages where url is not null and page_id is not null),
k as (select *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)='))) as query from p),
u as (select *, case when host = '' then url else host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end end as url_key from k),
r as (select url_key, start as time, page_id * 3 as record_id, sha1(html) as digest, tag, (start - 1000)::varchar as modified, length(html)::varchar as size from u),
v as (select page_id * 3 + 1 as record_id, url_key, start + day as time, case when page_id % 2 = 1 then 'W/' || tag else tag end as etag, null as modified from u
    union all select page_id * 3 + 2, url_key, start + 2 * day, null, (start - case when page_id % 5 = 0 then 1 else 1000 end)::varchar from u where page_id % 11 <> 0),
j as (select v.*, r.record_id as of_id, r.time as of_time, r.digest as of_digest, r.tag as of_tag, r.modified as of_modified, r.size,
    row_number() over (partition by v.record_id, v.url_key, v.time order by r.time desc, r.record_id desc) as n
    from v left join r on v.url_key = r.url_key and r.time < v.time),
s as (select *, case when of_id is null then 'missing' when etag is not null and regexp_replace(etag, '^W/', '') = of_tag or etag is null and modified = of_modified
    then 'resolved' else 'mismatch' end as state from j where n = 1)
select record_id, url_key, time, state, case when state = 'resolved' then of_id end as refers_to, case when state = 'resolved' then of_time end as refers_time,
    case when state = 'resolved' then of_digest end as digest,
    case when state = 'resolved' then
        case when etag is not null then 'cache-control=max-age=3600;content-length=' || size || ';content-type=text/html;date=' || time || ';etag=' || etag || ';last-modified=' || of_modified
        else 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=' || time || ';etag=' || of_tag || ';last-modified=' || modified end
    when etag is not null then 'cache-control=max-age=3600;content-length=0;date=' || time || ';etag=' || etag
    else 'date=' || time || ';last-modified=' || modified || ';server=x' end as headers from s
"""


class _Unpacked(io.RawIOBase):
    """What the members of gzip data hold, as far as they can be unpacked: a break or an error is the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.ready = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready and (self.at < len(self.data) or self.member.unconsumed_tail):
            part = self.member.unconsumed_tail or bytes(self.data[self.at : self.at + (1 << 16)])
            if not self.member.unconsumed_tail:
                self.at += len(part)
            try:
                self.ready = self.member.decompress(part, 1 << 18)
            except zlib.error:
                self.data = self.data[:0]
                self.member = zlib.decompressobj(31)
                return 0
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
        n = min(len(target), len(self.ready))
        target[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


#: Characters of a header line that are read; a longer one is no header of an archive.
LONGEST_LINE = 1 << 20


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzip: its headers, the HTTP status and headers if it holds an HTTP message, and the body.

    Reading ends at the first place that does not hold a whole record: other bytes, a break in the file or in its
    compressed data, a length that is no number. The records before it are given. Compressed files are unpacked as they
    are read, so one record at a time is held.
    """
    file = io.BufferedReader(_Unpacked(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)

    def headers() -> dict[str, str] | None:
        out: dict[str, str] = {}
        while (line := file.readline(LONGEST_LINE)).strip() != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        return out if line else None

    def taken(size: int) -> bytes:
        """At most so many bytes; room is made only for what is there, whatever the stated length."""
        out = bytearray()
        while size > len(out) and (part := file.read(min(size - len(out), 1 << 20))):
            out += part
        return bytes(out)

    def record() -> dict | None:
        line = file.readline(LONGEST_LINE)
        while line in (b"\r\n", b"\n"):
            line = file.readline(LONGEST_LINE)
        if not line.startswith(b"WARC/") or (named := headers()) is None or not (size := named.get("content-length", "")).isascii() or not size.isdigit():
            return None
        body = taken(int(size))
        if len(body) < int(size):
            return None
        http, status = {}, None
        if body.startswith(b"HTTP/"):
            head, _, body = body.partition(b"\r\n\r\n")
            first, *rest = head.decode("latin-1").split("\r\n")
            status = int(m[1]) if (m := re.match(r"HTTP/\S+ ([0-9]{3})", first)) else None
            http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in rest)}
        return {"warc": named, "status": status, "http": http, "body": body}

    while (found := record()) is not None:
        yield found


def read_warc(files: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Records of WARC files, as ``resolve_revisits`` takes them, from rows of (path, content), such as Spark's binaryFile gives.

    record_id is a hash of the WARC-Record-ID; time is that of WARC-Date; profile is WARC-Profile; other record types are
    passed over. Records leave a task in groups of about ``most_bytes``.
    """
    import hashlib
    from datetime import datetime

    from pairforge.shared import ship

    ship(files.sparkSession)
    names = ["record_id", "url", "time", "kind", "status", "headers", "digest", "profile", "body"]

    def run(batches):
        import pandas as pd

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"status": "Int32", "time": "Int64"})

        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for r in parse_warc(bytes(content) if content is not None else b""):
                    kind = r["warc"].get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    try:
                        time = int(datetime.fromisoformat(r["warc"].get("warc-date", "").replace("Z", "+00:00")).timestamp())
                    except ValueError:
                        time = None
                    key = int.from_bytes(hashlib.sha256(r["warc"].get("warc-record-id", "").encode()).digest()[:8], "big", signed=True)
                    rows.append((key, r["warc"].get("warc-target-uri"), time, kind, r["status"], r["http"], hashlib.sha1(r["body"]).hexdigest(), r["warc"].get("warc-profile"), r["body"]))
                    held += len(r["body"]) + 1000
                    if held > most_bytes:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    schema = "record_id bigint, url string, time bigint, kind string, status int, headers map<string,string>, digest string, profile string, body binary"
    return files.select("content").mapInPandas(run, schema)
