"""Operators on single texts: tokenizer, TIFF media, secrets, licences, quality."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pairforge.llm import bpe, licences, quality, queries, secrets, tiff

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "A" * 5000, "päss 日本語 🙂 x", "word " * 30_000, "tab\there\r\nline", "\x1c\x1d\x85"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", -1, "clash", "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", -1, "clash", "clash"), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, copy string")


@pytest.fixture(scope="module")
def own():
    import public_tokenizers

    return bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})


def test_bpe_equals_the_library(own, theirs):
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("abcdeé \n\t12.,'stß", k=300)) for _ in range(200)] + ["x" * n for n in (511, 512, 513, 2000)] + ["".join(rng.choices(a, k=n)) for a in ("ACGT", "ab", "aábßcdeéfgh", "的一是不了人我在有他") for n in (700, 6000)] + ["it's we'll 'tis", " lead", "trail ", "a  b", "½²1"]
    for text in texts:
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text), repr(text[:40])
        assert own.decode(ids) == text.encode()


def test_bpe_with_a_full_cache_and_a_tiny_vocabulary(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 700)
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"abcabc"]
    own = bpe.Encoder(tokens, r"\S+|\s+")
    for _ in range(2):
        assert own.encode("abcabc bcab") == [259, 32, 258, 256]
        assert own.encode("aaa bbb ccc abab") == [97, 97, 97, 32, 98, 98, 98, 32, 99, 99, 99, 32, 256, 256]


def test_bpe_of_any_ranks_against_plain_merging():
    """Ranks where a merged pair may come before its parts, as no trained vocabulary needs to avoid."""
    rng = random.Random(5)
    for _ in range(60):
        more = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(rng.randrange(3, 40))}
        tokens = [bytes([b]) for b in range(256)] + rng.sample(sorted(more), len(more))
        own, ranks = bpe.Encoder(tokens, r"\S+|\s+"), {t: i for i, t in enumerate(tokens)}
        for n in (1, 2, 7, 30, 200):
            text = "".join(rng.choices("abc", k=n))
            parts = [bytes([b]) for b in text.encode()]
            while found := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]:
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert own.encode(text) == [ranks[p] for p in parts]


def test_bpe_query(spark, odd, theirs):
    import public_tokenizers

    def want(text):
        ids = theirs.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    for docs, run in ((spark.read.parquet(f"{SF}/documents.parquet"), queries.op9_byte_bpe(spark, SF)), (odd, bpe.byte_bpe(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))):
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run.collect()), key=repr)
        assert got == sorted(((r.doc_id, *want(r.text)) for r in docs.collect()), key=repr)


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("form", [{}, {"tile": (16, 32)}, {"rows_per_strip": 7}])
def test_tiff_round_trip(compression, form):
    rng = np.random.default_rng(1)
    for predictor in (1, 2):
        for kind in (np.uint8, np.uint16, np.uint32):
            for order in "<>":
                pages = [tiff.Page(rng.integers(0, 200, (37, 45, n)).astype(kind) // 50, compression, predictor, **form) for n in (1, 3)]
                got = list(tiff.read_pages(tiff.write_pages(pages, order)))
                assert len(got) == 2 and all((a.samples == b.samples).all() for a, b in zip(pages, got, strict=True))


def test_lzw_and_packbits_of_many_sizes():
    rng = random.Random(2)
    for n in [*range(40), 127, 128, 129, 4000, 70_000]:
        for alphabet in (1, 2, 256):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
            assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


def test_tiff_pages_of_good_broken_and_missing_files(spark):
    page = tiff.Page(np.arange(48, dtype=np.uint8).reshape(6, 8, 1), tiff.LZW, 2)
    good = tiff.write_pages([page, page])
    loop = bytearray(good)
    first = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[first : first + 2], "little")
    loop[first + 2 + 12 * n : first + 6 + 12 * n] = good[4:8]
    files = [("good", good), ("cut", good[:-40]), ("none", None), ("empty", b""), ("loop", bytes(loop)), ("text", b"not a tiff at all")]
    rows = tiff.tiff_pages(spark.createDataFrame(files, "name string, content binary"), "name", "content").collect()
    by = {k: [r for r in rows if r.id == k] for k, _ in files}
    assert [r.data for r in by["good"]] == [bytes(range(48))] * 2 and not any(r.error for r in by["good"])
    assert [bool(r.error) for r in by["cut"]] == [False, True] and [bool(r.error) for r in by["loop"]] == [False, True]
    assert all(len(by[k]) == 1 and by[k][0].error for k in ("none", "empty", "text"))


def by_hand(width, height, tags, blocks, order="<", tiled=False):
    """A TIFF file of one page put together without the writer: blocks are the strips' or tiles' stored bytes."""
    import struct

    data, places = b"", []
    for block in blocks:
        places.append(8 + len(data))
        data += block + b"\0" * (len(block) % 2)
    tags = {256: [width], 257: [height], **tags, (324 if tiled else 273): places, (325 if tiled else 279): [len(b) for b in blocks]}
    at = 8 + len(data)
    beyond, entries = at + 2 + 12 * len(tags) + 4, b""
    more = b""
    for tag, values in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}I", *values)
        if len(raw) > 4:
            more, raw = more + raw, struct.pack(order + "I", beyond + len(more))
        entries += struct.pack(order + "HHI", tag, 4, len(values)) + raw
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + data + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + more


def test_published_examples_of_the_codes():
    packed, plain = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed, 24) == plain and tiff.packbits_decode(tiff.packbits_encode(plain), 24) == plain
    # 7 7 7 8 8 7 7 6 6 as the format's description has it: clear, 7, 258, 8, 8, 258, 6, 6, end
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stored = int(codes.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(stored, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) == tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9)


@pytest.mark.parametrize("order", "<>")
def test_files_put_together_by_hand(order):
    read = lambda *a, **k: next(tiff.read_pages(by_hand(*a, order=order, **k)))
    one = read(10, 2, {258: [1], 278: [1]}, [b"\xa5\x40", b"\x0f\x80"])
    assert one.samples[:, :, 0].tolist() == [[1, 0, 1, 0, 0, 1, 0, 1, 0, 1], [0, 0, 0, 0, 1, 1, 1, 1, 1, 0]] and one.bits == 1
    assert read(3, 1, {258: [4]}, [b"\x1f\x70"]).samples.ravel().tolist() == [1, 15, 7]
    assert read(3, 1, {258: [2]}, [b"\x6c"]).samples.ravel().tolist() == [1, 2, 3]
    planes = read(2, 1, {258: [8, 8, 8], 277: [3], 284: [2]}, [b"\x01\x02", b"\x03\x04", b"\x05\x06"])
    assert planes.samples.tolist() == [[[1, 3, 5], [2, 4, 6]]]
    tiles = read(20, 3, {258: [8], 322: [16], 323: [16], 259: [8]}, [zlib.compress(bytes(range(256))), zlib.compress(bytes([9]) * 256)], tiled=True)
    assert tiles.samples[2, :, 0].tolist() == [*range(32, 48), 9, 9, 9, 9]
    wide = np.array([1, 65535, 3], order + "u2").tobytes()
    assert read(3, 1, {258: [16], 259: [32773]}, [bytes([5]) + wide]).samples.ravel().tolist() == [1, 65535, 3]
    # floating-point differencing: the values' bytes in planes, high ones first, then differences from byte to byte
    values = np.array([[1.5, -2.25, 3e8, 0.1]], ">f4")
    parts = np.ascontiguousarray(values.view(np.uint8).reshape(4, 4).T).ravel()
    steps = np.diff(parts, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    floats = read(4, 1, {258: [32], 259: [8], 317: [3], 339: [3]}, [zlib.compress(steps)])
    assert floats.samples.ravel().view(np.float32).tolist() == values.astype(np.float32).ravel().tolist()


def test_files_that_make_no_sense_give_errors():
    bad = [
        {277: []}, {278: []}, {258: []}, {258: [8, 4]}, {258: [7]}, {259: [99]}, {266: [2]}, {284: [3]}, {317: [9]}, {317: [3]}, {258: [4], 317: [2]}, {256: [0]}, {257: [0]}, {256: [1 << 31]}, {277: [1 << 30]}, {278: [0]},
    ]
    for tags in bad:
        with pytest.raises(tiff.TiffError):
            list(tiff.read_pages(by_hand(2, 2, {258: [8], **tags}, [b"abcd"])))
    good = by_hand(2, 2, {258: [8]}, [b"abcd"])
    entry = good.index(b"\x11\x01\x04\x00")  # the strips' places, as a signed number below 0
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(good[: entry + 2] + b"\x09\x00" + good[entry + 4 : entry + 8] + b"\xf0\xff\xff\xff" + good[entry + 12 :]))
    rng = random.Random(11)
    whole = tiff.store(bytes(range(256)) * 18)
    for _ in range(3000):
        torn = bytearray(whole[: rng.randrange(len(whole) + 1)] if rng.random() < 0.3 else whole)
        for _ in range(rng.randrange(1, 6)):
            if torn:
                torn[rng.randrange(len(torn))] = rng.choice((0, 255, rng.randrange(256)))
        try:
            list(tiff.read_pages(bytes(torn)))
        except tiff.TiffError:
            pass


def test_payloads_of_every_size_come_in_every_form():
    rng = random.Random(9)
    forms = {}
    for units in (1, 2, 3, 7, 200, 500):
        for _ in range(30):
            raw = bytes(rng.choices(b"abc \n", k=units * 576))
            pages = list(tiff.read_pages(tiff.store(raw)))
            assert b"".join(p.samples.tobytes() for p in pages) == raw and max(p.samples.size for p in pages) <= 576 * tiff.MOST_UNITS
            forms.setdefault(units, set()).update((p.compression, p.predictor, p.tile is not None) for p in pages)
            if units >= 200:
                break
    assert all(len(f) == 3 for f in forms.values())


def plain_feature(full, pages):
    rows = [full[i : i + 24] for i in range(0, len(full), 24)]
    n, total, squares = len(full), sum(full), sum(b * b for b in full)
    steps = sum(abs(a - b) for r in rows for a, b in zip(r, r[1:], strict=False))
    return f"24x{len(rows)};pages={pages};mean={total * 1000 // n};sd={int((squares / n - (total / n) ** 2) ** 0.5 * 1000)};values={len(set(full))};steps={steps}"


def test_media_query(spark, odd):
    for docs, run in ((spark.read.parquet(f"{SF}/documents.parquet"), queries.op5_media_columns(spark, SF)), (odd, tiff.text_media(odd))):
        got = {}
        for r in run.collect():
            got.setdefault(r.doc_id, []).append(r)
        for d in docs.collect():
            raw = (d.text or "").encode()
            full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            for r in got[d.doc_id]:
                assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
                stored = tiff.store(full)
                assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
                pages = list(tiff.read_pages(stored))
                assert b"".join(p.samples.tobytes() for p in pages) == full
                said, want = r.feature.split(";"), plain_feature(full, len(pages)).split(";")
                assert said[:3] + said[4:] == want[:3] + want[4:] and abs(int(said[3][3:]) - int(want[3][3:])) <= 1
    assert run.count() == odd.count()


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_base_spans():
    rng = random.Random(4)
    bits = ["password", "Token", "=", ":", " ", '"', "AKIA", "ABCDEFGH", "0123", "deadbeef", "x", "é", "api_key", "\n", "abcdef12"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=14))
        assert secrets.base_spans(text) == plain_spans(text), text


def test_secrets_query_keeps_the_base(spark, odd):
    for docs, run in ((spark.read.parquet(f"{SF}/documents.parquet"), queries.op4_secret_scan(spark, SF)), (odd, secrets.scan_secrets(odd))):
        texts = {}
        for d in docs.collect():
            texts[d.doc_id] = d.text or ""
        assert run.count() == docs.count()
        for r in run.collect():
            base = plain_spans(texts[r.doc_id])
            said = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
            assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
            assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == said


@pytest.fixture(scope="module")
def formats():
    return secrets.learn_formats(secrets.labelled_examples())


@pytest.mark.parametrize("frame", ["{}", "NAME={}", "GITHUB={}", "https://h.org/{}", "api/js?key={}", "a+{}/b", "see {}.git", "x={}.git/y={}", "token={} "])
def test_formats_are_found_wherever_they_stand(formats, frame):
    for kind in secrets.FORMS:
        hit = total = 0
        for token in [t for k, t in secrets.labelled_examples(60, seed=991) if k == kind]:
            text = frame.replace("{}", token)
            found = secrets.format_spans(text, formats)
            for m in re.finditer(re.escape(token), text):
                hit += (m.start(), 3, m.end()) in found
                total += 1
        assert hit / total >= 0.95, kind


def test_formats_are_not_found_in_other_texts(formats):
    rng = random.Random(6)
    alnum = secrets._ALNUM
    drawn = lambda chars, *sizes: "-".join("".join(rng.choices(chars, k=n)) for n in sizes)
    texts = ["/".join("".join(rng.choices(["the", "er", "in", "tion", "heit", "ung", "Haus"], k=6)) for _ in range(5)) for _ in range(500)]
    texts += [drawn(alnum, n) for n in (20, 24, 32, 36, 39, 40, 64, 69) for _ in range(300)] + [drawn("0123456789abcdef", 8, 4, 4, 4, 12) for _ in range(300)] + [drawn(alnum + "+/", 200) for _ in range(100)]
    assert not any(secrets.format_spans(t, formats) for t in texts)


def plain_format_spans(text, formats):
    """Every part of every run between separators scored by itself."""
    found = []
    for run in re.finditer("[A-Za-z0-9+/_.=-]+", text):
        word = run[0]
        starts = [i for i in range(len(word)) if i == 0 or not word[i - 1].isalnum()]
        ends = [i + 1 for i in range(len(word)) if i + 1 == len(word) or not word[i + 1].isalnum()]
        near = []
        for kind, moves in formats.moves.items():
            longest = {}
            for end in ends:
                total, start = max(((secrets.odds(moves, word[s:end]), s) for s in starts if s < end), default=(float("-inf"), 0))
                if total >= formats.least[kind]:
                    longest[start] = (formats.least[kind] - total, run.start() + start, run.start() + end)
            near += longest.values()
        kept = []
        for _, s, e in sorted(near):
            if all(e <= a or b <= s for a, _, b in kept):
                kept.append((s, 3, e))
        found += sorted(kept)
    return found


def test_formats_against_brute_force(spark, formats):
    rng = random.Random(15)
    tokens = [t for _, t in secrets.labelled_examples(30, seed=5)]
    for _ in range(400):
        text = "".join(rng.choice([rng.choice(tokens), rng.choice(tokens)[: rng.randrange(50)], "=", "/", ".", "-", " ", "a", "token: ", "x1_"]) for _ in range(8))
        assert secrets.format_spans(text, formats) == plain_format_spans(text, formats), text
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_secret_scan(spark, SF).collect():
        spans = sorted(plain_spans(texts[r.doc_id]) + plain_format_spans(texts[r.doc_id], formats))
        assert r.spans == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_merging_generalises_and_keeps_what_differs():
    rng = random.Random(5)

    def geometric():
        n = 1
        while rng.random() < 0.7:
            n += 1
        return n

    loop = secrets.Automaton(["0" * geometric() for _ in range(500)]).infer()
    assert len(loop.scorer()) <= 4
    apart = secrets.Automaton(["a-1"] * 100 + ["Z+Z"] * 100).infer().scorer()
    assert secrets.odds(apart, "a-1") > secrets.odds(apart, "a+1") + 4 and secrets.odds(apart, "a?1") == float("-inf")
    assert secrets.shortest(apart) == 3 and secrets.shortest(loop.scorer()) == 1


def plain_dice(text):
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    grams = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    best = None
    for name, template in sorted(licences.TEMPLATES.items()):
        other = set(licences.bigrams(template))
        if grams:
            score = 2 * len(grams & other) / (len(grams) + len(other))
            if best is None or score >= best[0]:
                best = (score, name)
    return best if best and best[0] >= 0.8 else None


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i, (_, t) in enumerate(sorted(licences.TEMPLATES.items())):
        words = t.split()
        for cut in range(4):
            kept = [w for w in words if rng.random() > cut * 0.06]
            rows.append((100 * i + cut, "Some prose before.\n" + " ".join(kept) + "\nand after"))
            rows.append((100 * i + cut + 50, "\n".join(" ".join(kept[a : a + 9]) for a in range(0, len(kept), 9))))
    rows += [(i - 1000, t) for i, t in enumerate(ODD)]
    got = {(r.doc_id, r.line): (r.dice, r.licence) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        units = ([(0, text)] if len(lines) > 1 else []) + list(enumerate(lines, 1))
        want |= {(doc_id, k): hit for k, u in units if (hit := plain_dice(u))}
    assert got == want and len(want) > 60


def test_licences_inside_longer_texts(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choices("the of and to river stone software work is in any for copies".split(), k=n))
    wrap = lambda t, n, lead="": "\n".join(lead + " ".join(t.split()[a : a + n]) for a in range(0, len(t.split()), n))
    long = ["mit", "isc", "bsd-2-clause", "apache-2.0-header", "gpl-3.0-header", "mpl-2.0-header", "unlicense"]
    page = "\n".join(prose(12) for _ in range(40))
    rows = [(i, f"{page}\n{wrap(licences.TEMPLATES[k], 9, ' * ')}\n{page}") for i, k in enumerate(long)]
    rows += [(100, f"Copyright 2020 X. {prose(60)}. Released under the MIT License. {prose(60)}"), (101, page), (102, f"{page}\nReleased under the MIT License.\n{page}")]
    rows += [(103, f"{page}\n{wrap(licences.TEMPLATES['isc'], 7)}\n{page}\nReleased under the BSD License.\n{prose(50)} this work has been released into the public domain. {prose(9)}")]
    got = sorted((r.doc_id, r.line, r.licence) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string"), windows=True).collect())
    last = 41 + -(-len(licences.TEMPLATES["isc"].split()) // 7) + 40
    want = [(i, 41, k) for i, k in enumerate(long)] + [(long.index("apache-2.0-header"), 41, "apache-2.0-notice"), (100, 1, "mit-notice"), (102, 41, "mit-notice"), (103, 41, "isc"), (103, last, "bsd-notice"), (103, last + 1, "public-domain-notice")]
    assert got == sorted(want)


def test_quality_learns_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in test) / len(test) >= 0.95


def test_quality_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1)) for i in range(60)], "doc_id bigint, text string")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    one = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    two = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(60)], "doc_id bigint, quality int")
    score = lambda labels: sorted((r.doc_id, r.score) for r in quality.score_quality(docs, labels).collect())
    assert held and score(one) == score(two)


def test_quality_of_odd_rows_and_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.score_quality(odd, none).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    assert quality.keep_quality(odd, none, threshold=0.4).columns == odd.columns
    assert quality.keep_quality(odd, none, threshold=0.4).count() == odd.count() and quality.keep_quality(odd, none).count() == 0
    assert quality.score_quality(odd.limit(0), none).count() == 0


def test_additive_model_needs_pairs_for_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000], rounds=30, pair_rounds=60, pairs=3)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 and (0, 1) in model.pairs
    bins = [np.searchsorted(c, x[:5, j], "right") for j, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:5, j], "right") for j, c in enumerate(model.coarse)]
    total = model.base + sum(v[b] for v, b in zip(model.values, bins, strict=True)) + sum(g[rough[a], rough[b]] for (a, b), g in zip(model.pairs, model.grids, strict=True))
    assert model.score(x[:5]) == pytest.approx(1 / (1 + np.exp(-total)))


def test_empty_tables(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id bigint, text string")
    for run in (tiff.text_media(docs), secrets.scan_secrets(docs), licences.scan_licences(docs), bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        assert run.count() == 0
