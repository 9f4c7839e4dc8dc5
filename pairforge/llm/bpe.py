"""Byte-level BPE encoding and decoding with length-bucketed matrices.

Distinct pieces of a block of texts are laid out as padded integer matrices, one for each length bucket. In every
round each row merges its leftmost pair of least rank; ranks come from a hashed pair table, rows without a
mergeable pair leave the matrix, and the merged rows close up. Results of pieces are kept in a bounded cache.

Null texts count as empty and give no ids. Ids decode to the exact UTF-8 bytes of the text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.rows import per_row, text_of

NONE = np.int32(2**31 - 1)
#: The characters of the Unicode property White_Space, as the library's regular expressions take them.
SPACE = "\t-\r \x85\xa0  -     　"
#: Bytes that the cache holds, estimated, before it is emptied; a block of texts may pass it by what that block holds.
CACHED_BYTES = 72 << 20


@cache
def _classes(end: int) -> tuple[str, str]:
    """Letters and numbers below a code point as ranges of a character class, from the Unicode categories L* and N*."""
    found = {"L": [], "N": []}
    for kind, ranges in found.items():
        start = None
        for cp in range(end + 1):
            inside = cp < end and unicodedata.category(chr(cp))[0] == kind
            if inside and start is None:
                start = cp
            elif not inside and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
                start = None
    return "".join(found["L"]), "".join(found["N"])


@cache
def compiled(pattern: str, end: int = sys.maxunicode + 1) -> re.Pattern:
    """The split pattern for ``re``, with its Unicode classes and white space written out as ranges.

    It holds for texts of code points below ``end``; a short class is much faster to test.
    """
    letters, numbers = _classes(end)
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letters}{numbers}]")
    inside = inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    inside = inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return re.compile(inside)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids (base64 token, space, rank on each line)."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks in {path} are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


class PairTable:
    """Maps pairs of ids to the id of their concatenation by open addressing in two numpy arrays."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        keys, merged = [], []
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, values = np.array(keys, np.int64), np.array(merged, np.int32)
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]  # of several for one slot the last stays
            placed = free & (self.keys[slot] == todo)
            self.values[slot[placed]] = values[placed]
            todo, values, slot = todo[~placed], values[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair does not merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Encoder:
    """Encodes and decodes texts by the tokens of a rank file and a split pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.split_any, self.split_latin = compiled(pattern).findall, compiled(pattern, 0x100).findall
        self.table = PairTable(tokens)
        # one object for each id, which all results share
        self.numbers = np.empty(len(tokens), object)
        self.numbers[:] = range(len(tokens))
        self.whole = dict(zip(tokens, self.numbers.tolist(), strict=True))
        self.byte = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        self.decimal = [str(i) for i in range(len(tokens))]
        self.ids: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn([pieces])
        return self.joined(pieces)

    def split(self, text: str) -> list[str]:
        """The matches of the split pattern."""
        return (self.split_latin if text.isascii() or max(text) < "\u0100" else self.split_any)(text)

    def joined(self, pieces: list[str]) -> list[int]:
        """The ids of pieces that were learned."""
        return list(chain.from_iterable(map(self.ids.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def learn(self, texts: list[list[str]]) -> None:
        """Puts all pieces of a block of texts into the cache, which is emptied first if it is full."""
        if self.held > CACHED_BYTES:
            self.ids, self.held = {}, 0
        found = self._pieces(set(chain.from_iterable(texts)).difference(self.ids))
        self.ids.update(found)
        self.held += 240 * len(found) + 4 * sum(map(len, found))

    def _pieces(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct matches of the pattern."""
        out: dict[str, tuple[int, ...]] = {}
        rows: dict[int, tuple[list[str], list[bytes]]] = {}
        whole = self.whole.get
        for piece in pieces:
            raw = piece.encode()
            if (known := whole(raw)) is not None:
                out[piece] = (known,)
            else:
                # widths 4, 6, 8, 12, 16, 24 and so on
                n = max(len(raw), 4) - 1
                half = 1 << n.bit_length() - 2
                width = 3 * half if n < 3 * half else 4 * half
                bucket = rows.get(width)
                if bucket is None:
                    bucket = rows[width] = [], []
                bucket[0].append(piece)
                bucket[1].append(raw)
        for width, (names, raws) in rows.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(names), step):
                out.update(zip(names[at : at + step], map(tuple, self._by_matrix(raws[at : at + step], width)), strict=True))
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """The ids of pieces of up to ``width`` bytes: rows of a matrix that all merge at once, round after round.

        In a round a row merges its leftmost pair of least rank, and with it the next pairs of that rank as long as
        merging them one by one would go on to them: until a merge makes a pair of lesser rank.
        """
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        at = np.arange(width)
        ids = np.where(at < sizes[:, None], self.byte[raw], -1).astype(np.int32)
        ranks = np.full((len(pieces), width), NONE, np.int32)
        inside = at[1:] < sizes[:, None]
        ranks[:, :-1][inside] = self.table.get(ids[:, :-1][inside], ids[:, 1:][inside])
        out: list[list[int] | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            least = ranks.min(1)
            over = least == NONE
            if over.any():
                for r, ended, size in zip(row[over].tolist(), self.numbers[ids[over]].tolist(), sizes[over].tolist(), strict=True):
                    out[r] = ended[:size]
                stay = ~over
                row, sizes, ids, ranks, least = row[stay], sizes[stay], ids[stay], ranks[stay], least[stay]
                if not len(row):
                    break
            line, place = self._merges(ids, ranks, least, sizes)
            ids[line, place] = least[line]
            keep = np.arange(ids.shape[1]) < sizes[:, None]
            keep[line, place + 1] = False
            merged = np.zeros(ids.shape, bool)
            merged[line, place] = True
            sizes = sizes - np.bincount(line, minlength=len(row))
            ids, ranks = self._closed(ids[keep], ranks[keep], merged[keep], sizes)
        return out

    def _merges(self, ids: np.ndarray, ranks: np.ndarray, least: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that merge in this round as (row, place), by row and place."""
        line, place = np.nonzero(ranks == least[:, None])
        if len(line) == len(least):
            return line, place
        # of overlapping pairs in a run every second one, from its first
        first = np.append(True, (line[1:] != line[:-1]) | (place[1:] != place[:-1] + 1))
        at = np.arange(len(line))
        free = (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
        line, place = line[free], place[free]
        if len(line) == len(least):
            return line, place
        # the pairs that a merge makes with what stands left of it by then and right of it still
        new = least[line]
        touched = np.append(False, (line[1:] == line[:-1]) & (place[1:] == place[:-1] + 2))
        lesser = np.zeros(len(line), bool)
        some = np.flatnonzero(place > 0)
        left = np.where(touched[some], new[some], ids[line[some], place[some] - 1])
        lesser[some] = self.table.get(left, new[some]) < new[some]
        some = np.flatnonzero(place + 2 < sizes[line])
        lesser[some] |= self.table.get(new[some], ids[line[some], place[some] + 2]) < new[some]
        if lesser.any():
            begin = np.searchsorted(line, np.arange(len(least)))
            before = np.append(0, np.cumsum(lesser))[:-1]
            go = before == before[begin][line]
            line, place = line[go], place[go]
        return line, place

    def _closed(self, ids: np.ndarray, ranks: np.ndarray, merged: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows without the gaps that merges left, from what stays of all rows one after another, with new ranks beside merges."""
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        flat = np.flatnonzero(inside)
        ends = np.cumsum(sizes) - 1
        changed = merged.copy()
        changed[:-1] |= merged[1:]
        changed[ends] = False
        ranks[ends] = NONE
        at = np.flatnonzero(changed)
        ranks[at] = self.table.get(ids[at], ids[at + 1])
        shape = len(sizes), width
        new_ids, new_ranks = np.full(shape, -1, np.int32), np.full(shape, NONE, np.int32)
        new_ids.ravel()[flat], new_ranks.ravel()[flat] = ids, ranks
        return new_ids, new_ranks


_encoders: dict[tuple, Encoder] = {}


def encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = (len(tokens), pattern, hashlib.md5(b"\0".join(tokens)).digest())
    if key not in _encoders:
        _encoders[key] = Encoder(tokens, pattern)
    return _encoders[key]


def byte_bpe(docs: DataFrame, rank_file: str, pattern: str, *, with_ids: bool = True) -> DataFrame:
    """Encodes every text and decodes the ids again; one row for each input row.

    Returns doc_id, ids (array of int, if ``with_ids``), n_tokens, ids_sha256 (of the decimal ids joined by one
    space) and decoded_sha256 (of the bytes that the ids decode to). Null texts count as empty: no ids, n_tokens 0
    and the digests of the empty string. Repeated rows give repeated results; other columns are not read. The rank
    file is read on the driver and broadcast: its size is that of a vocabulary, whatever the input.
    """
    tokens = read_ranks(rank_file)
    shipped = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(rows: list[tuple]) -> list[tuple]:
        own = encoder_of(shipped, pattern)
        out = []
        collects = gc.isenabled()
        gc.disable()  # the cache holds many small objects and no cycles
        try:
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                cut = [own.split(text) for _, text in part]
                own.learn(cut)
                for (doc_id, _), pieces in zip(part, cut, strict=True):
                    ids = own.joined(pieces)
                    said = " ".join([own.decimal[i] for i in ids])
                    decoded = own.decode(ids)
                    row = (len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    out.append((doc_id, ids, *row) if with_ids else (doc_id, *row))
        finally:
            if collects:
                gc.enable()
        return out

    schema = "doc_id bigint, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return per_row(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), ["doc_id", "text"], schema, run)


_own: dict[int, Encoder] = {}


def encoder_of(shipped, pattern: str) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    key = (shipped._jbroadcast.id() if getattr(shipped, "_jbroadcast", None) is not None else id(shipped), pattern)
    if key not in _own:
        _own.clear()
        _own[key] = encoder(shipped.value, pattern)
    return _own[key]
