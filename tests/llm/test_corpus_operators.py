"""Operators on whole corpora: mixing, lines, revisits, exact and near copies, and the pipeline."""

import gzip
import hashlib
import os
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import assert_same, connect  # noqa: E402

from pairforge.llm import exact, jaccard, lines, mixing, queries, warc  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows():
    return [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "x\ny", None), (4, "x\ny", None), (5, "w " * 40_000, "a"), (None, "no id", "b"), (6, "ÄB ab\tAB", "b"), (7, "äb AB", "b")]


def test_mixture_rates_order_and_draws(spark):
    rows = [(i, "t" * 10, "big" if i % 3 else "small") for i in range(6000)]
    out = mixing.mix_sources(documents(spark, rows), {"big": 1.0, "small": 3.0}).cache()
    got = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got["small"] / 6000 == pytest.approx(0.75, abs=0.03) and got["big"] / 6000 == pytest.approx(0.25, abs=0.03)
    # counts of a Poisson distribution: mean equals variance
    counts = out.filter("source = 'small'").groupBy("doc_id").count().collect()
    n = [r["count"] for r in counts] + [0] * (2000 - len(counts))
    mean = sum(n) / len(n)
    assert sum((x - mean) ** 2 for x in n) / len(n) == pytest.approx(mean, rel=0.12)
    parts = [[r.place for r in p] for p in out.rdd.glom().collect()]
    assert sum(parts, []) == sorted(sum(parts, [])) and len([p for p in parts if p]) > 1
    again = mixing.mix_sources(documents(spark, rows[::-1]).repartition(5), {"big": 1.0, "small": 3.0})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_mixture_by_salted_join_and_large_rates(spark, monkeypatch):
    rows = [(i, "t", f"s{i % 7}") for i in range(700)] + [(10_000, "t", "rare"), (10_001, "t", None)]
    docs = documents(spark, rows).withColumn("copy", F.lit("clash"))
    one = sorted(map(tuple, mixing.mix_sources(docs, {"rare": 0.5, None: 0.5}).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    assert sorted(map(tuple, mixing.mix_sources(docs, {"rare": 0.5, None: 0.5}).collect())) == one
    assert len(one) == pytest.approx(702, abs=120) and {r[0] for r in one} == {10_000, 10_001}


def test_mixture_of_odd_and_empty_tables(spark):
    out = mixing.mix_sources(documents(spark, odd_rows()))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copies", "copy", "place"}
    assert all(1 <= r.copy <= r.copies for r in out.collect())
    assert mixing.mix_sources(documents(spark, odd_rows()).limit(0)).count() == 0


def test_line_dedup_rules(spark):
    frame = "Home | About"
    rows = [(i, f"{frame}\n text {i} \n\n{frame} ", "a") for i in range(30)] + [(100, frame, "a"), (101, f"{frame}\nx", "b"), (102, None, "a"), (103, "", "a")]
    docs = documents(spark, rows + [rows[0]]).withColumn("n_dropped", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_boilerplate(docs, ratio=0.5).collect()}
    assert got[0] == (" text 0 \n", 2)
    assert got[100] == (frame, 0) and got[101] == (f"{frame}\nx", 0) and got[102] == (None, 0) and got[103] == ("", 0)
    assert lines.drop_boilerplate(docs, ratio=0.5).count() == len(rows) + 1
    # the ratio decides on a host of a few pages too, and a lone page keeps its lines
    few = documents(spark, [(i, f"{frame}\nown {i}", "few") for i in range(4)] + [(9, f"{frame}\nown", "lone")])
    assert sorted((r.doc_id, r.text) for r in lines.drop_boilerplate(few).collect()) == [(i, f"own {i}") for i in range(4)] + [(9, f"{frame}\nown")]
    odd = documents(spark, odd_rows())
    assert sorted(map(repr, lines.drop_boilerplate(odd).drop("n_dropped").collect())) == sorted(map(repr, odd.collect()))
    assert lines.drop_boilerplate(odd.limit(0)).count() == 0


RECORDS = "record_id bigint, url string, time bigint, kind string, status int, headers map<string,string>, digest string"


def test_revisits(spark):
    url = "http://www.Ex.org:80/a/?b=2&a=1&utm_x=3#top"
    rows = [
        (1, "https://ex.org/a?a=1&b=2", 100, "response", 200, {"etag": '"x"', "server": "s", "date": "1"}, "d1"),
        (2, url, 200, "response", 200, {"etag": '"y"', "content-length": "7"}, "d2"),
        (3, url, 200, "revisit", 304, {"etag": '"x"'}, None),  # the response of the same second is not earlier
        (4, url, 300, "revisit", 304, {"etag": 'W/"y"', "date": "9", "content-length": "0"}, None),
        (5, url, 301, "revisit", 304, {"etag": '"z"'}, None),
        (6, url, 50, "revisit", 304, {}, None),
        (7, url, 900_000, "revisit", 304, None, None),
        (8, url, 250, "response", 404, {}, "no"),
        (9, None, 1, "revisit", 304, {}, None),
        (10, "not a url", 5, "revisit", 304, {}, None),
    ]
    df = spark.createDataFrame(rows + [rows[3]], RECORDS).withColumn("response", F.lit("clash"))
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.state, r.refers_to) for k, r in got.items()} == {3: ("resolved", 1), 4: ("resolved", 2), 5: ("mismatch", None), 6: ("missing", None), 7: ("resolved", 2), 10: ("missing", None)}
    assert got[4].headers == {"etag": 'W/"y"', "date": "9", "content-length": "7"} and got[3].headers == {"etag": '"x"', "server": "s", "date": "1"}
    assert got[7].url_key == "ex.org/a?a=1&b=2" and warc.resolve_revisits(df).count() == 7
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_a_hot_url_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "http://h/x" if i % 3 else f"http://h/{i % 50}", rng.randrange(40_000), *rng.choice([("response", 200), ("revisit", 304)]), {}, str(i)) for i in range(1500)]
    got = {r.record_id: r.refers_to for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    want = {}
    for i, url, t, kind, *_ in rows:
        if kind == "revisit":
            want[i] = max(((t2, j) for j, u2, t2, k2, *_ in rows if k2 == "response" and u2 == url and t2 < t), default=(None, None))[1]
    assert got == want


def test_only_not_modified_revisits_resolve(spark):
    address = "http://netpreserve.org/warc/1.1/revisit/"
    kinds = [(address + "server-not-modified", 304), (address + "Server-Not-Modified/", None), (address + "server-not-modified", 200), (address + "identical-payload-digest", 304), (None, 304), (None, 200), (None, None)]
    rows = [(100, "http://e/x", 5, "response", 200, {}, "d", None)] + [(i, "http://e/x", 9, "revisit", status, {}, None, profile) for i, (profile, status) in enumerate(kinds)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS + ", profile string")).collect()
    assert {r.record_id for r in got} == {0, 1, 4} and {r.state for r in got} == {"resolved"}


def test_bodies_that_begin_alike_have_other_etags(spark):
    start = "<!doctype html><html lang=en><head><meta charset=utf-8></head>" + " " * 40
    pages = spark.createDataFrame([(1, "http://e/x", start + "one"), (2, "http://e/x", start + "two")], "page_id bigint, url string, html string")
    got = {r.record_id: (r.state, r.refers_to) for r in warc.page_revisits(pages).collect()}
    # page 1's revisit a day later meets page 2's response, which is another body
    assert got[4] == ("mismatch", None) and got[7] == ("resolved", 6)


def test_warc_files(spark):
    def record(kind, key, body, extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{key}>\r\nWARC-Date: 2024-01-01T00:00:0{key[-1]}Z\r\nWARC-Target-URI: http://e.org/a\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    data = record("warcinfo", "u0", b"x") + record("response", "u1", b"HTTP/1.1 200 OK\r\nETag: \"q\"\r\n\r\nbody") + record("revisit", "u2", b"HTTP/1.1 304 Not Modified\r\nETag: \"q\"\r\n\r\n")
    packed = gzip.compress(data)
    rng = random.Random(3)
    torn = [data[:k] for k in (0, 5, 60, 150)] + [packed[:k] for k in (2, 11, 40)] + [bytes(rng.randrange(256) for _ in range(300)), packed[:30] + b"\xff" * 40, b"WARC/1.0\r\nContent-Length: -3\r\n\r\n", b"WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\nx"]
    assert [len(list(warc.parse_warc(x))) for x in torn if x[:2] != b"\x1f\x8b"] == [0, 0, 0, 1, 0, 0, 0] and all(len(list(warc.parse_warc(x))) < 3 for x in torn)
    assert not list(warc.parse_warc(gzip.compress(torn[-1])))
    assert len(list(warc.parse_warc(data[:-3]))) == 3 and len(list(warc.parse_warc(gzip.compress(data) + gzip.compress(data)[:-9]))) in (5, 6)
    files = spark.createDataFrame([("a", packed), ("c", None), *(("b", x) for x in torn if len(x) < 100)], "path string, content binary")
    records = warc.read_warc(files)
    assert [(r.kind, r.status, bytes(r.body)) for r in records.orderBy("time").collect()] == [("response", 200, b"body"), ("revisit", 304, b"")]
    out = warc.resolve_revisits(records).collect()
    assert [r.state for r in out] == ["resolved"] and out[0].digest == hashlib.sha1(b"body").hexdigest()


def test_exact_groups(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(100 + i, rng.choice(["Same", "SAME", "same", "other", "ÄX", "äx"]), "s") for i in range(400)]
    docs = documents(spark, rows).repartition(13).select("*", F.lit(1).alias("leaf"), F.lit("c").alias("digest"))
    got = sorted(map(tuple, exact.exact_groups(docs).collect()), key=repr)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t, _ in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact.exact_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run_rows", [7, 1 << 17])
def test_exact_groups_in_many_leaves_and_lanes(spark, tmp_path, monkeypatch, run_rows):
    monkeypatch.setattr(exact, "RUN_ROWS", run_rows)
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else str(rng.randrange(400)), "s") for i in range(1500)]
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = sorted(map(tuple, exact.exact_groups(documents(spark, rows).repartition(70)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    last, size = {}, {}
    for i, t, _ in rows:
        last[t], size[t] = i, size.get(t, 0) + 1
    assert got == [(i, last[t], size[t], i == last[t], hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows]


def test_merge_of_runs_keeps_the_greatest_and_counts():
    import numpy as np

    a, b, c = bytes(32), bytes(31) + b"\x01", b"\xff" * 32
    run = lambda *rows: (b"".join(d for d, _, _ in rows), np.array([k for _, k, _ in rows]), np.array([n for _, _, n in rows]))
    digests, keeps, sizes = exact.merge_runs([run((a, 7, 2), (b, 1, 1)), run((a, exact.NO_ID, 3)), run((a, 9, 4), (c, 5, 1))])
    assert digests == a + b + c and keeps.tolist() == [9, 1, 5] and sizes.tolist() == [9, 1, 1]
    parts = [(to, d) for to, d, _, _ in exact._sent((digests, keeps, sizes), 5, 0, 8, 1)]
    assert parts == [(0, a + b), (7, c)]


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(4):
        text = rng.choices(words, k=120)
        for _ in range(45):
            copy = list(text)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = rng.choice(words) if rng.random() < 0.5 else f"own{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choices(words, k=60))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choices(words, k=rng.randrange(3, 40)))) for i in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "one", "ONE", "two words", "Two\twords", "a b c d", "A b c d", " ", rows[3][1].upper(), rows[3][1]])]
    return rows


@pytest.mark.parametrize(("words", "percent", "chunk"), [(4, 85, 512), (5, 80, 16), (2, 60, 512)])
def test_jaccard_against_brute_force(spark, tmp_path, monkeypatch, words, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_copies(words)
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "d"))
    got = jaccard.jaccard_components(spark.read.parquet(str(tmp_path / "d")), words=words, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, words, percent)


def test_jaccard_in_small_blocks_and_of_long_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    long = [rng.choice("abcdefghij") + str(rng.randrange(9000)) for _ in range(40_000)]
    rows = [(i, t) for i, t in near_copies(7)] + [(5000, " ".join(long)), (5001, " ".join(long[:38_000]))]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    got = jaccard.jaccard_components(spark.read.parquet(str(tmp_path / "d")), words=4, percent=85)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 4, 85)
    empty = spark.read.parquet(str(tmp_path / "d")).limit(0)
    assert jaccard.jaccard_components(empty).count() == 0


def test_blocks_never_outgrow_their_places(monkeypatch):
    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(jaccard, "TaskContext", Task)
    n = 70_000
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(lo, hi)), "text": [f"w{i} x" for i in range(lo, hi)]}) for lo, hi in ((0, 59_990), (59_990, 69_990), (69_990, n))]
    ids, spots = {}, []
    for r in (r for part in jaccard._cut(2, 8)(iter(batches)) for r in part.to_pylist()):
        if r["kind"] == jaccard.DOCUMENT:
            ids[r["block"], r["place"]] = r["doc_id"]
        elif r["kind"] != jaccard.COUNTED:
            spots += [((r["block"], p), t) for p, t in zip(jaccard._places(r["places"]).tolist(), jaccard._unplanes(r["tokens"]).tolist(), strict=True)]
    assert sorted(ids.values()) == list(range(n)) and max(p for _, p in ids) < 1 << 16
    want = jaccard.shingles(pa.array([f"w{i} x" for i in range(n)]), 2)[1].tolist()
    assert len(spots) == n and all(want[ids[at]] == token for at, token in spots)


def test_repeated_ids_stand_for_one_document(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words stand here now"), (None, "a b c")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    kept = jaccard.keep_one_of_each(spark.read.parquet(str(tmp_path / "d")))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 1, 3, None]


def test_pipeline_stages(spark, con):
    import corpus_pipeline as pipeline

    from pairforge.llm import bpe, quality

    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES][0] == "quality classifier" and len(pipeline.STAGES) == 5
    from pairforge.shared import stash

    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    one = stash(pipeline.drop_low_quality(spark, docs, SF), "t")
    assert one.columns == pipeline.COLUMNS and {r.doc_id for r in one.collect()} == {k for k, v in scores.items() if v}
    two = stash(pipeline.drop_lines(spark, one, SF), "t")
    con.register("one", one.toPandas())
    sql = "with documents as (select * from one), " + lines.oracle().strip().removeprefix("with")
    want = {r[0]: r[1] for r in con.sql(f"select doc_id, text from ({sql})").fetchall()}
    assert {r.doc_id: r.text for r in two.collect()} == want and all(r.n_chars == len(r.text) for r in two.collect())
    three = stash(pipeline.drop_near_copies(spark, two, SF), "t")
    classes = brute_components([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert sorted(r.doc_id for r in three.collect()) == [d for d, _, c in classes if d == c]
    four = stash(pipeline.mix(spark, three, SF), "t")
    assert four.columns == pipeline.COLUMNS and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    own = bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    sizes = sorted((r.doc_id, len(own.encode(r.text))) for r in four.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, SF).collect()) == sizes


def plain_mixture(rows, seed=20, exponent=0.5):
    """Copies of (doc_id, text, source) rows: Poisson draws by adding up the distribution, part by part."""
    import math

    mass = {}
    for _, text, source in rows:
        mass[source] = mass.get(source, 0) + len(text or "")
    mass = {s: max(m, 1) for s, m in mass.items()}
    total, shares = sum(mass.values()), sum(m**exponent for m in mass.values())
    out = []
    for doc_id, _, source in rows:
        rate = mass[source] ** exponent * total / (shares * mass[source])
        parts = max(math.ceil(rate / 16), 1)
        copies = 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = below = math.exp(-rate / parts)
            k = 0
            while below <= u and k < 100:
                k += 1
                p *= rate / parts / k
                below += p
                copies += 1
        out += [doc_id] * copies
    return sorted(out, key=repr)


def test_mixture_against_plain_draws(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows in (docs, odd_rows()):
        got = sorted((r.doc_id for r in mixing.mix_sources(documents(spark, rows)).collect()), key=repr)
        assert got == plain_mixture(rows)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, an extra column of a clashing name, and empty tables, stage by stage."""
    import corpus_pipeline as pipeline
    import numpy as np
    import public_tokenizers

    from pairforge.llm import bpe, quality
    from pairforge.shared import stash

    own = bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("n_chars")).limit(6).collect()]
    rows = odd_rows() + [(20 + i, t, "c" if i else None) for i, t in enumerate(good)] + [(20, good[0], None), (40, good[1].replace(" ", "  ", 3), "c"), (41, "frame line here\n" + good[2], "d"), (42, "frame line here\nown words of one page", "d")]
    docs = stash(documents(spark, rows).withColumn("copies", F.lit("clash")).withColumn("score", F.lit(0)), "odd")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    scored = [(i, t) for i, t, _ in rows if model.score(np.array([quality.describe(t or "")]))[0] >= 0.7]
    one = stash(pipeline.drop_low_quality(spark, docs, SF), "t")
    assert one.columns == pipeline.COLUMNS and key(one) == sorted(scored, key=repr)
    # the later stages see all of the odd rows
    two = stash(pipeline.drop_lines(spark, docs, SF), "t")
    lines_of = lambda t: {x.strip(" ") for x in (t or "").split("\n")} - {""}
    pages = {}
    for _, t, s in rows:
        pages.setdefault(s, []).append(lines_of(t))
    want = []
    for i, t, s in rows:
        bad = {x for x in lines_of(t) if (n := sum(x in p for p in pages[s])) > 1 and n > 0.02 * len(pages[s])}
        kept = [x for x in (t or "").split("\n") if x.strip(" ") not in bad]
        want.append((i, "\n".join(kept) if bad and any(x.strip(" ") for x in kept) else t))
    assert two.columns == pipeline.COLUMNS and key(two) == sorted(want, key=repr)
    three = stash(pipeline.drop_near_copies(spark, docs, SF), "t")
    classes = brute_components([(i, t) for i, t, _ in rows if i is not None], 5, 80)
    stay = {d for d, _, c in classes if d == c} | {None}
    assert three.columns == pipeline.COLUMNS and key(three) == sorted(((i, t) for i, t, _ in rows if i in stay), key=repr)
    four = stash(pipeline.mix(spark, docs, SF), "t")
    assert four.columns == pipeline.COLUMNS and sorted((r.doc_id for r in four.collect()), key=repr) == plain_mixture(rows)
    five = pipeline.encode(spark, docs, SF)
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in five.collect()), key=repr) == sorted(((i, len(own.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=repr)
    empty = stash(docs.limit(0), "t")
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in pipeline.STAGES)


def test_jaccard_of_many_short_texts_with_a_token_that_all_share(spark, tmp_path):
    """More documents than a block has places, in one file: two and two are near copies, and all hold one passage."""
    n = 70_000
    text = lambda i: "shared words here now " + " ".join(f"w{i // 2}x{j}" for j in range(14)) + f" end{i % 2}"
    spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.udf(text)("id").alias("text")).write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = jaccard.jaccard_components(spark.read.parquet(str(tmp_path / "d")), words=4, percent=80).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == n and all(r.component_id == r.doc_id // 2 * 2 and r.n_shingles == 16 for r in got)


def test_jaccard_of_a_long_list_of_documents_that_do_not_link(spark, tmp_path, monkeypatch):
    """A long passage and few own words: hundreds of documents stand in the list of a frequent token, most of them apart."""
    monkeypatch.setattr(jaccard, "CHUNK", 48)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for i in range(420):
        own = [f"o{i}x{j}" for j in range(rng.choice((12, 12, 12, 13, 11, 3)))]
        at = rng.randrange(2)
        rows.append((i, " ".join(own + passage if at else passage + own)))
    rows += [(1000 + i, rows[i * 7][1] + " tail") for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = jaccard.jaccard_components(spark.read.parquet(str(tmp_path / "d")), words=4, percent=85)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 4, 85)
