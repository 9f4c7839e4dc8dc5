"""Media columns: TIFF files as rows, one row for each page.

``read_pages`` walks the chain of image directories of a TIFF file, decodes strips or tiles that are stored plainly
or with PackBits, LZW or deflate, undoes horizontal differencing of whole numbers and of floating-point ones and returns
one row per page. Samples have 1, 2, 4, 8, 16, 32 or 64 bits, side by side or in planes. ``write_pages`` stores pages of
8, 16 or 32 bits losslessly in the same forms.

A file that breaks off, contradicts itself or holds something unknown gives one row with ``error`` set and no samples
from there on; pages before it are kept. Null or empty files give one such row. A directory chain that returns to an earlier
directory ends with an error row.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.llm.rows import per_row, slices, text_of
from pairforge.shared import ship

# Tags, field types and compression codes of TIFF 6.0.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 266, 284, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Side of a page of the text payloads: 24 x 24 samples, 576 bytes.
SIDE = 24


class TiffError(ValueError):
    """The file breaks off or holds something that this reader does not know."""


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats, all else literals, at most 128 bytes each."""
    if not data:
        return b""
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(raw)))
    long_ = np.flatnonzero(sizes >= 3)
    out, at = bytearray(), 0

    def literal(until: int) -> None:
        nonlocal at
        while at < until:
            n = min(128, until - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for start, size in zip(starts[long_].tolist(), sizes[long_].tolist(), strict=True):
        literal(start)
        for done in range(0, size, 128):
            n = min(128, size - done)
            out.extend((257 - n, data[start]) if n > 1 else (0, data[start]))
        at = start + size
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise TiffError("PackBits data break off")
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Variable-length codes from the high bit on, widened one code early, as TIFF has them."""
    out, bits, acc, have = bytearray(), 9, 256, 9
    table: dict[int, int] = {}  # code of a string, then its next byte -> code of the longer string
    prefix, after = -1, 258
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        longer = table.get(key)
        if longer is not None:
            prefix = longer
            continue
        acc, have = acc << bits | prefix, have + bits
        table[key] = after
        after += 1
        prefix = byte
        if after == 4094:
            acc, have = acc << 12 | 256, have + 12
            table, bits, after = {}, 9, 258
        elif after in (512, 1024, 2048):
            bits += 1
        if have > 512:
            rest = have % 8
            out += (acc >> rest).to_bytes(have // 8, "big")
            acc, have = acc & ((1 << rest) - 1), rest
    if prefix >= 0:
        acc, have = acc << bits | prefix, have + bits
        if after + 1 in (512, 1024, 2048):
            bits += 1
    acc, have = acc << bits | 257, have + bits
    pad = -have % 8
    out += (acc << pad).to_bytes((have + pad) // 8, "big")
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, bits, acc, have, out, last = list(first), 9, 0, 0, [], b""
    made = 0
    for byte in data:
        acc, have = (acc << 8 | byte) & 0xFFFFFF, have + 8
        if have < bits:
            continue
        have -= bits
        code = acc >> have & ((1 << bits) - 1)
        if code == 257 or made >= size:
            break
        if code == 256:
            table, bits, last = list(first), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW data begin with an unknown code")
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise TiffError("LZW data hold an unknown code")
            table.append(last + word[:1])
            if len(table) in (511, 1023, 2047):
                bits += 1
        out.append(word)
        made += len(word)
        last = word
    if made < size:
        raise TiffError("LZW data break off")
    return b"".join(out)[:size]


def _pack(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise TiffError(f"compression {compression}")


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data[:size]
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError("the samples break off")
    return out


@dataclass
class Page:
    """A page as stored: samples as (height, width, samples per pixel)."""

    samples: np.ndarray
    compression: int = PLAIN
    predictor: int = 1
    tile: tuple[int, int] | None = None  # height, width; both multiples of 16
    rows_per_strip: int | None = None
    photometric: int = 1
    bits: int | None = None  # of a stored sample; those of the array's type if it says nothing


def _blocks(page: Page) -> Iterator[np.ndarray]:
    height, width, _ = page.samples.shape
    if page.tile:
        th, tw = page.tile
        padded = np.pad(page.samples, ((0, -height % th), (0, -width % tw), (0, 0)))
        for y in range(0, height, th):
            for x in range(0, width, tw):
                yield padded[y : y + th, x : x + tw]
    else:
        step = page.rows_per_strip or height
        for y in range(0, height, step):
            yield page.samples[y : y + step]


def write_pages(pages: list[Page], order: str = "<") -> bytes:
    """A TIFF file of the pages; ``order`` is "<" (II) or ">" (MM)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, n = page.samples.shape
        kind = page.samples.dtype.newbyteorder(order)
        offsets, sizes = [], []
        for block in _blocks(page):
            if page.predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], 1)
            raw = _pack(np.ascontiguousarray(block).astype(kind).tobytes(), page.compression)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        bits = page.samples.dtype.itemsize * 8
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [bits] * n, COMPRESSION: [page.compression], PHOTOMETRIC: [page.photometric], SAMPLES: [n], PREDICTOR: [page.predictor]}
        if page.tile:
            tags |= {TILE_HEIGHT: [page.tile[0]], TILE_WIDTH: [page.tile[1]], TILE_OFFSETS: offsets, TILE_BYTES: sizes}
        else:
            tags |= {ROWS_PER_STRIP: [page.rows_per_strip or height], STRIP_OFFSETS: offsets, STRIP_BYTES: sizes}
        entries = []
        for tag in sorted(tags):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR)
            values = struct.pack(order + ("H" if short else "I") * len(tags[tag]), *tags[tag])
            if len(values) > 4:
                at = len(out)
                out += values + b"\0" * (len(values) % 2)
                values = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, 3 if short else 4, len(tags[tag])) + values.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in FIELD:
                continue
            form = f"{order}{count}{FIELD[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + struct.calcsize(form) > len(data):
                raise TiffError(f"the values of tag {tag} lie outside the file")
            tags[tag] = list(struct.unpack_from(form, data, place))
        (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError(f"a directory lies outside the file: {e}") from e
    return tags, after


#: How many times its stored form a page may be: more than any of the codes can make of a byte.
MOST_GROWTH = 4096


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> Page:
    try:
        return _decoded(data, tags, order)
    except TiffError:
        raise
    except (KeyError, ValueError, IndexError, TypeError, OverflowError, struct.error) as e:
        raise TiffError(f"a needed tag is missing or makes no sense: {e!r}") from e


def _decoded(data: bytes, tags: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, usual=None: tags[tag][0] if usual is None or tag in tags else usual
    width, height, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor, planes, form = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    bits = set(tags.get(BITS, [1]))
    tiled = TILE_OFFSETS in tags
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if min(width, height, n, bh, bw) < 1 or min(offsets, default=0) < 0 or min(sizes, default=0) < 0:
        raise TiffError(f"{width} x {height} x {n} in blocks of {bw} x {bh}")
    size = bits.pop()
    if bits or size not in (1, 2, 4, 8, 16, 32, 64) or planes not in (1, 2) or one(FILL_ORDER, 1) != 1 or form not in (1, 2, 3, 4):
        raise TiffError(f"samples of {sorted(bits | {size})} bits, planes {planes}, fill order {one(FILL_ORDER, 1)}, format {form}")
    if predictor not in (1, 2, 3) or (predictor == 2 and size < 8) or (predictor == 3 and (form != 3 or size < 16)):
        raise TiffError(f"predictor {predictor} of samples of {size} bits and format {form}")
    together, apart = (n, 1) if planes == 1 else (1, n)
    across, down = -(-width // bw), -(-height // bh)
    if width * height * n * size // 8 > MOST_GROWTH * max(len(data), 1) or across * down * apart > len(offsets) or across * down * apart > len(sizes):
        raise TiffError("strips or tiles are missing")
    kind = np.dtype(f"{order}u{max(size // 8, 1)}")
    samples = np.zeros((height, width, n), kind.newbyteorder("="))
    line = -(-bw * together * size // 8)
    for i in range(across * down * apart):
        plane, place = divmod(i, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, height - y)
        if offsets[i] + sizes[i] > len(data):
            raise TiffError("strips or tiles lie outside the file")
        if rows * line > MOST_GROWTH * max(sizes[i], 1):
            raise TiffError("a strip or tile is larger than its data can hold")
        raw = _unpack(data[offsets[i] : offsets[i] + sizes[i]], compression, rows * line)
        if size < 8:
            split = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : bw * together * size]
            weights = (1 << np.arange(size)[::-1]).astype(np.uint8)
            block = (split.reshape(rows, bw, together, size) * weights).sum(3, dtype=np.uint8)
        elif predictor == 3:
            steps = np.frombuffer(raw, np.uint8).reshape(rows, bw * kind.itemsize, together)
            parts = np.add.accumulate(steps, 1, np.uint8).reshape(rows, kind.itemsize, bw * together)  # the high bytes first
            block = np.ascontiguousarray(parts.transpose(0, 2, 1)).view(f">u{kind.itemsize}").reshape(rows, bw, together)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, bw, together)
        block = block.astype(samples.dtype)
        if predictor == 2:
            block = np.add.accumulate(block, 1, samples.dtype)
        samples[y : y + bh, x : x + bw, plane : plane + together] = block[: height - y, : width - x]
    return Page(samples, compression, predictor, (bh, bw) if tiled else None, None if tiled else bh, one(PHOTOMETRIC, 1), size)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file; raises TiffError at the first that can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, after = _directory(data, at, order)
        yield _page(data, tags, order)
        at = after


PAGES = "id string, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def _page_rows(key: str | None, data: bytes | None) -> Iterator[tuple]:
    k = -1
    try:
        for k, p in enumerate(read_pages(data or b"")):  # noqa: B007
            h, w, n = p.samples.shape
            raw = p.samples.astype(p.samples.dtype.newbyteorder("<")).tobytes()
            yield (key, k, w, h, n, p.bits, p.compression, p.predictor, p.tile is not None, raw, None)
    except TiffError as e:
        yield (key, k + 1, None, None, None, None, None, None, None, None, str(e))


def tiff_pages(files: DataFrame, id_column: str, content: str, carry: Sequence[str] = (), most_bytes: int = 8 << 20) -> DataFrame:
    """One row for each page of each TIFF file in the binary column ``content``, with its samples row by row.

    Samples of 16 bits and more come in little-endian order, those of fewer than 8 bits as a byte each. Columns named in
    ``carry`` stand beside every page of their file. Files are read one at a time; a page is the unit of memory. Pages
    of a file follow each other in its partition, the file's own order kept. Other columns are not read, repeated rows
    give repeated pages; for broken and null files see the module's text.
    """
    ship(files.sparkSession)
    taken = files.select(F.col(id_column).cast("string").alias("id"), F.col(content).cast("binary").alias("content"), *carry)
    schema = T.StructType([*T._parse_datatype_string(PAGES).fields, *taken.schema.fields[2:]])
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for part in slices(batch):
                for key, data, *beside in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for row in _page_rows(key, data):
                        rows.append((*row, *beside))
                        held += len(row[9] or b"") + 500
                        if held > most_bytes:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return taken.mapInArrow(run, schema)


def payload(text: str) -> bytes:
    """The text's UTF-8 bytes, with bytes 255 up to a positive multiple of a page's 576."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // SIDE**2)) * SIDE**2, b"\xff")


#: The forms of a payload's pages, in turn.
FORMS = [{"compression": PACKBITS, "rows_per_strip": 4 * SIDE}, {"compression": LZW, "rows_per_strip": 8 * SIDE}, {"compression": DEFLATE, "predictor": 2, "tile": (48, 32)}]
#: Units of 576 bytes that a page of a payload holds at most.
MOST_UNITS = 64


def store(raw: bytes) -> bytes:
    """A payload as a TIFF file of grey pages, 24 samples wide.

    Its units of 576 bytes are dealt in order to pages of nearly equal size: three, or a multiple of three where pages
    would pass 64 units, or as many as there are units if those are fewer. Pages are PackBits strips, LZW tiles with
    differencing and deflate strips with differencing in turn; a checksum of the payload says which form is the first and
    the order of the file's bytes. So payloads of every size come in every form.
    """
    units, mark = len(raw) // SIDE**2, zlib.crc32(raw)
    count = min(units, len(FORMS) * -(-units // (len(FORMS) * MOST_UNITS)))
    cuts = [units * k // count * SIDE**2 for k in range(count + 1)]
    pages = [Page(np.frombuffer(raw[lo:hi], np.uint8).reshape(-1, SIDE, 1), **FORMS[(mark + k) % len(FORMS)]) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return write_pages(pages, "<>"[mark >> 8 & 1])


def _stored(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        media = store(payload(text))
        out.append((doc_id, len(text.encode()), len(media), hashlib.sha256(media).hexdigest(), media))
    return out


class _Described:
    """What is gathered of a file's pages, one after another."""

    def __init__(self, row: dict):
        self.row, self.digest, self.tail, self.size = row, hashlib.sha256(), b"", 0
        self.pages = self.rows = self.steps = 0
        self.counts = np.zeros(256, np.int64)

    def add(self, width: int, height: int, data: bytes) -> None:
        x = np.frombuffer(data, np.uint8).reshape(height, width)
        self.digest.update(data)
        self.tail, self.size = (self.tail + data[-32:])[-32:], self.size + len(data)
        self.pages, self.rows = self.pages + 1, self.rows + height
        self.steps += int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64))
        self.counts += np.bincount(x.ravel(), minlength=256)

    def done(self) -> tuple:
        values, n = np.arange(256), max(self.size, 1)
        total, squares = int(self.counts @ values), int(self.counts @ values**2)
        deviation = math.isqrt(max(0, squares * n - total * total) * 1_000_000) // n
        feature = f"{SIDE}x{self.rows};pages={self.pages};mean={total * 1000 // n};sd={deviation};values={int((self.counts > 0).sum())};steps={self.steps}"
        r = self.row
        return (r["doc_id"], r["n_bytes"], self.size, self.digest.hexdigest(), zlib.crc32(self.tail), r["media_bytes"], r["media_sha256"], feature)


MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every whole text as a TIFF file, reads the stored files' pages back and describes them; one row per input row.

    Null texts count as empty: a page of 576 bytes 255. Equal texts give equal values. The feature is the samples' width
    and height over all pages, the number of pages, the mean and standard deviation of the samples in thousandths, the
    number of distinct samples and the sum of absolute differences of neighbours in a row. Nothing is shuffled: pages
    of a file follow each other, and one file's are gathered at a time.
    """
    files = per_row(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), ["doc_id", "text"], "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, content binary", _stored)
    pages = tiff_pages(files, "doc_id", "content", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    schema = T._parse_datatype_string(MEDIA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out = None, []
        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    if row["error"] is not None:
                        raise TiffError(f"the stored file of document {row['doc_id']}: {row['error']}")
                    if row["page"] == 0:
                        if file is not None:
                            out.append(file.done())
                        file = _Described(row)
                    file.add(row["width"], row["height"], row["data"])
                    file.row.pop("data", None)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(file.done(), arrow, strict=True)], schema=arrow)

    return pages.mapInArrow(run, schema)
