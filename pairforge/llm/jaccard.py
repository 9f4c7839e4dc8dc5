"""N-gram Jaccard join with prefix filters under several global orders of the tokens.

Tokens are 64-bit hashes of word shingles. Two documents of sizes n and m that reach a similarity t share a token of
the first n - ceil(t n) + 1 of one and m - ceil(t m) + 1 of the other under *any* order that holds for all documents.
The join uses three orders, each from rare tokens to frequent ones, with other hashes inside a frequency class; a
pair is a candidate only if its prefixes meet under all three.

Steps, all of them linear in the input but for what really meets:

1. Blocks of documents are cut into shingles; the tokens go out as packed runs by ranges of the token space, where
   the documents of every token are counted. A token that many documents of a block share goes out once, with their
   number. Tokens of a single document can be in no intersection: the others go back to their blocks. A document with
   fewer than ceil(t n) of them links with nothing and is out.
2. Documents with equal sets form classes; one of a class goes on.
3. Postings of the prefixes under the first order give, for each token, a star of pairs around one document; filters,
   then exact verification, then components. As only components are asked for, a second star is taken only from
   tokens whose documents still lie in several components.
4. What is still apart is compared in blocks: tokens with the same documents count once, their documents are dealt
   into chunks of bounded size by component and size, and two chunks meet in a task if a pair of theirs can link. A pair
   is looked at in the list of its first common token, so what its sets hold from there on bounds the overlap; counts
   of tokens by 64 hash classes bound it too. Pairs that these bounds and the filters leave are verified there. No link
   that joins components is lost: every pair of a token's documents in different components is looked at, or excluded
   by a bound on its overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.rows import flat_schema, slices, text_of
from pairforge.operators.graph import connected_components
from pairforge.shared import release, ship, stash, tidy

U = np.uint64
#: Odd multipliers of the hashes.
_R, _M1, _M2, _K = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
#: A block of documents ends when it has so many shingles or documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 60_000
#: A token that so many documents of a block have leaves the block once, with their number.
FREQUENT = 32

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h + U(salt)
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = U(pow(int(_R), -1, 1 << 64))
        for k, base in enumerate((_R, inverse)):
            steps = np.full(n + n // 4, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of the texts as (place of the text, 64-bit token), repeated ones too, and each text's number of words.

    Words are runs of anything but blank and bytes 9 to 13, with A-Z in lower case. A text with fewer words than a
    shingle has, but some, gives all its words as a single one.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    solid = ~_WHITE[data]
    before = np.append(False, solid[:-1]) & ~border[:-1]
    after = np.append(solid[1:], False) & ~border[1:]
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    power, inverse = _power(n)
    sums = np.append(U(0), np.cumsum((data.astype(U) + U(1)) * power[:n], dtype=U))
    word = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * _K)
    doc = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.append(0, np.cumsum(count))[:-1]

    def joined(at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), U(size))
        for i in range(size):
            h = mix(h * _K + word[at + i])
        return h

    at = np.arange(max(0, len(word) - words + 1))
    at = at[doc[at] == doc[at + words - 1]]
    docs, tokens = [doc[at]], [joined(at, words)]
    for size in range(1, words):
        short = np.flatnonzero(count == size)
        docs.append(short)
        tokens.append(joined(first[short], size))
    return np.concatenate(docs), np.concatenate(tokens), count


def _planes(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane: the high planes are mostly zeros and compress."""
    steps = np.diff(values, prepend=U(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view("<u8").ravel(), dtype=U)


# Kinds of rows: documents (block, place, doc_id, n, d1, d2), tokens of a block with their places and those that come back
# as shared; a block's frequent tokens with their numbers, what comes back of them, and their places, which stay behind.
DOCUMENT, TOKENS, SHARED, COUNTED, LEVELS, HELD = range(6)
PARTS = "key bigint, kind int, block bigint, place int, doc_id bigint, n bigint, d1 bigint, d2 bigint, tokens binary, places binary, classes binary"
_parts = flat_schema(PARTS)


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _parts], schema=_parts)


class _Block:
    """Documents that are gathered in a task until their shingles are sent out together."""

    def __init__(self, buckets: int):
        self.buckets, self.number = buckets, 0
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.docs: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, docs: np.ndarray, tokens: np.ndarray) -> None:
        self.docs.append((docs + len(self.ids)).astype(np.uint16))
        self.tokens.append(tokens)
        self.ids += ids
        self.size += len(tokens)

    def full(self) -> bool:
        return self.size >= BLOCK_SHINGLES or len(self.ids) >= BLOCK_DOCS

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        assert len(self.ids) <= 1 << 16, "places in a block are of 16 bits"
        block = TaskContext.get().partitionId() << 24 | self.number
        self.number += 1
        docs, tokens = np.concatenate(self.docs), np.concatenate(self.tokens)
        self.docs, self.tokens = [], []
        order = np.lexsort((docs, tokens))
        docs, tokens = docs[order], tokens[order]
        new = np.ones(len(docs), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
        docs, tokens = docs[new], tokens[new]
        del order, new
        n = np.bincount(docs, minlength=len(self.ids))
        digests = []
        for salt in (0x51ED, 0xC0FFEE):
            sums = np.zeros(len(self.ids), U)
            np.add.at(sums, docs, mix(tokens, salt))
            digests.append(sums.view(np.int64))
        # documents travel in groups of 256 until they meet their block's shared tokens
        key = -1 - (block * 256 + np.arange(len(self.ids)) // 256)
        yield _rows(key=key, kind=np.zeros(len(key), np.int32), block=np.full(len(key), block), place=np.arange(len(key), dtype=np.int32), doc_id=self.ids, n=n, d1=digests[0], d2=digests[1])
        # of equal sets within the block, one is enough
        _, one = np.unique(np.stack([*digests, n]), axis=1, return_index=True)
        sent = np.zeros(len(self.ids), bool)
        sent[one] = True
        keep = sent[docs]
        docs, tokens = docs[keep], tokens[keep]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(tokens)))
        frequent = np.repeat(times >= FREQUENT, times)
        yield from self._runs(block, TOKENS, tokens[~frequent], docs[~frequent])
        if frequent.any():
            yield from self._runs(block, COUNTED, tokens[starts[times >= FREQUENT]], times[times >= FREQUENT])
            held, places = tokens[frequent], docs[frequent]
            for at in range(0, len(held), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield _rows(key=[-1 - (block * 256 + 255)], kind=[HELD], block=[block], tokens=[_planes(held[part])], places=[_pairs_of_bytes(places[part])])
        self.clear()

    def _runs(self, block: int, kind: int, tokens: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ascending tokens with a number of 16 bits each, cut by ranges of the token space."""
        bucket = ((tokens >> U(32)) * U(self.buckets)) >> U(32)
        cut = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(tokens))
        for at in range(0, len(cut) - 1, 64):
            part = list(zip(cut[at : at + 64].tolist(), cut[at + 1 : at + 65].tolist(), strict=False))
            yield _rows(
                key=[int(bucket[lo]) for lo, _ in part], kind=[kind] * len(part), block=[block] * len(part),
                tokens=[_planes(tokens[lo:hi]) for lo, hi in part], places=[_pairs_of_bytes(values[lo:hi]) for lo, hi in part],
            )


def _pairs_of_bytes(values: np.ndarray) -> bytes:
    """Numbers below 65,536, low bytes first, then high bytes."""
    return np.ascontiguousarray(values.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def _places(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _cut(words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(buckets)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                while part.num_rows:
                    # no more than the block has room for: places are of 16 bits
                    piece = part.slice(0, BLOCK_DOCS - len(block.ids))
                    part = part.slice(piece.num_rows)
                    docs, tokens, _ = shingles(piece.column(1), words)
                    block.add(piece.column(0).to_pylist(), docs, tokens)
                    if block.full():
                        yield from block.send()
        yield from block.send()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one range of the token space: tokens of two documents or more, by block, with their frequency classes.

    Rows of documents and of tokens that stayed behind pass as they are.
    """
    if table.column("kind")[0].as_py() in (DOCUMENT, HELD):
        return table
    blocks, kinds = table.column("block").to_numpy(), table.column("kind").to_numpy()
    tokens = [_unplanes(x.as_py()) for x in table.column("tokens")]
    places = np.concatenate([_places(x.as_py()) for x in table.column("places")])
    source = np.repeat(np.arange(len(blocks)), [len(t) for t in tokens])
    tokens = np.concatenate(tokens)
    weight = np.where(kinds[source] == COUNTED, places.astype(np.int64), 1)
    order = np.argsort(tokens, kind="stable")
    sorted_ = tokens[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    frequency = np.repeat(np.add.reduceat(weight[order], starts), np.diff(np.append(starts, len(sorted_))))
    keep = frequency > 1
    order, frequency = order[keep], frequency[keep]
    level = np.minimum(255, np.log2(frequency) * 8).astype(np.uint8)
    by = np.argsort(source[order], kind="stable")
    order, level = order[by], level[by]
    cut = np.searchsorted(source[order], np.arange(len(blocks) + 1))
    out = [(b, LEVELS if k == COUNTED else SHARED, lo, hi) for b, k, lo, hi in zip(blocks.tolist(), kinds.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True) if hi > lo]
    made = [] if not out else [_rows(
        key=[b for b, _, _, _ in out], kind=[k for _, k, _, _ in out], block=[b for b, _, _, _ in out],
        tokens=[_planes(tokens[order[lo:hi]]) for _, _, lo, hi in out],
        places=[_pairs_of_bytes(places[order[lo:hi]]) if k == SHARED else None for _, k, lo, hi in out],
        classes=[level[lo:hi].tobytes() for _, _, lo, hi in out],
    )]
    return pa.Table.from_batches(made, schema=_parts)


DOCS = "doc_id bigint, n bigint, d1 bigint, d2 bigint, tokens binary, classes binary"
_docs = flat_schema(DOCS)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens a set of n must share with another at least."""
    return -(-n * percent // 100)


def _gathered(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block: every document, with its shared tokens from rare to frequent if they can be enough."""
        kind = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kind == DOCUMENT)).sort_by("place")
        runs, levels, held = (table.filter(pa.array(kind == k)) for k in (SHARED, LEVELS, HELD))
        n = docs.column("n").to_numpy()
        tokens: list = [None] * len(n)
        classes: list = [None] * len(n)
        if len(runs) or len(held):
            joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind, copy=False)
            token = joined([_unplanes(x.as_py()) for x in runs.column("tokens")], U)
            place = joined([_places(x.as_py()) for x in runs.column("places")], np.uint16)
            level = joined([np.frombuffer(x.as_py(), np.uint8) for x in runs.column("classes")], np.uint8)
            if len(held):
                known = joined([_unplanes(x.as_py()) for x in levels.column("tokens")], U)
                order = np.argsort(known)
                of = joined([np.frombuffer(x.as_py(), np.uint8) for x in levels.column("classes")], np.uint8)[order]
                more = joined([_unplanes(x.as_py()) for x in held.column("tokens")], U)
                token, level = np.concatenate([token, more]), np.concatenate([level, of[np.searchsorted(known[order], more)]])
                place = np.concatenate([place, joined([_places(x.as_py()) for x in held.column("places")], np.uint16)])
            enough = np.bincount(place, minlength=len(n)) >= np.maximum(_needed(n, percent), 1)
            keep = enough[place]
            token, place, level = token[keep], place[keep], level[keep]
            order = np.lexsort((token, level, place))
            token, place, level = token[order], place[order], level[order]
            cut = np.searchsorted(place, np.arange(len(n) + 1))
            for i in np.flatnonzero(enough).tolist():
                tokens[i] = token[cut[i] : cut[i + 1]].astype("<i8").tobytes()
                classes[i] = level[cut[i] : cut[i + 1]].tobytes()
        names = ["doc_id", "n", "d1", "d2"]
        return pa.Table.from_arrays([*(docs.column(c).combine_chunks() for c in names), pa.array(tokens, pa.binary()), pa.array(classes, pa.binary())], schema=_docs)

    return run


def _prefixes(n: int, tokens: bytes, classes: bytes, percent: int) -> list[np.ndarray]:
    """A set's prefixes under the three orders, as far as they hold shared tokens (single ones come before all others)."""
    token, level = np.frombuffer(tokens, "<i8"), np.frombuffer(classes, np.uint8)
    size = max(0, n - int(_needed(np.int64(n), percent)) + 1 - (n - len(token)))
    raw = token.view(np.uint64)
    second = np.lexsort((mix(raw, 0xABCD), level))[:size]
    third = np.lexsort((mix(raw, 0x1357), level >> 3))[:size]
    return [token[:size], token[second], token[third]]


def _marks(tokens: np.ndarray, salt: int) -> int:
    """64 bits that tokens set: prefixes that meet have a common bit."""
    bits = np.uint64(1) << (mix(tokens.view(np.uint64), salt) >> U(58))
    return int(np.bitwise_or.reduce(bits).astype(np.int64)) if len(bits) else 0


POSTINGS = "token bigint, pos bigint, node bigint, n bigint, s bigint, marks2 bigint, marks3 bigint"
_postings = flat_schema(POSTINGS)


def _post(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                columns: list[list] = [[] for _ in _postings]
                for node, n, tokens, classes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    first, second, third = _prefixes(n, tokens, classes, percent)
                    k = len(first)
                    columns[0] += first.tolist()
                    # the token's place in the whole set: tokens of this document alone come before all others
                    columns[1] += range(n - len(classes), n - len(classes) + k)
                    for column, value in zip(columns[2:], (node, n, len(classes), _marks(second, 1), _marks(third, 2)), strict=True):
                        column += [value] * k
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _postings, strict=True)], schema=_postings)

    return run


_tested = flat_schema("a bigint, b bigint, linked boolean")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8 << 20):
                a, b, linked = [], [], []
                for x, y, n, tokens, classes, m, tokens2, classes2 in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    meet = all(len(np.intersect1d(p, q)) for p, q in zip(_prefixes(n, tokens, classes, percent)[1:], _prefixes(m, tokens2, classes2, percent)[1:], strict=True))
                    both = len(np.intersect1d(np.frombuffer(tokens, "<i8"), np.frombuffer(tokens2, "<i8"), assume_unique=True)) if meet else 0
                    a.append(x)
                    b.append(y)
                    linked.append(meet and 100 * both >= percent * (n + m - both))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], schema=_tested)

    return run


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Tests pairs (a, b) of nodes exactly: (a, b, linked), stashed."""
    left = sets.select(F.col("node").alias("a"), "n", "tokens", "classes")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("tokens2"), F.col("classes").alias("classes2"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "tokens", "classes", "m", "tokens2", "classes2")
    return stash(rows.mapInArrow(_verify(percent), "a bigint, b bigint, linked boolean"), "tested")


def _could(percent: int):
    """Filters that need no tokens: sizes, numbers of shared tokens, and the marks of the second and third order."""
    n, m = F.col("n"), F.col("n_")
    near = (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.least("s", "s_") * (100 + percent) >= (n + m) * percent)
    for marks in ("marks2", "marks3"):
        near &= F.col(marks).bitwiseAND(F.col(marks + "_")) != 0
    return near


#: Documents of a chunk of a token's documents, and hash classes of a document's outline.
CHUNK, CLASSES = 256, 64
#: Sets whose sizes differ by less than this factor are of one size class.
STEP = 1.05
SALTS = 16
OUTLINES = "node bigint, outline binary, tokens binary"
_outlines = flat_schema(OUTLINES)
_pairs = flat_schema("a bigint, b bigint")


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the number of its shared tokens in each hash class."""
    for batch in batches:
        for part in slices(batch, 4 << 20):
            counts = [np.bincount((mix(np.frombuffer(t.as_py(), "<u8"), 0x77) >> U(58)).astype(np.int64), minlength=CLASSES).astype("<u4").tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.binary()), part.column(1)], schema=_outlines)


def _blocks(percent: int):
    """Of sorted rows (list, lo, hi, side, node, component, n, rest, marks2, marks3, outline, tokens): links between components.

    Pairs of both sides that no bound excludes are tested exactly, likely ones first. What a link has joined counts as
    one component for the rest of the group, so a group gives fewer links than it has documents.
    """

    def links(group: pa.Table) -> Iterator[tuple[int, int]]:
        side = group.column("side").to_numpy()
        one = np.flatnonzero(side == 0)
        other = np.flatnonzero(side == 1) if (side == 1).any() else one
        names, root = group.column("node").to_numpy(), group.column("component").to_numpy().copy()
        if (root == root[0]).all():
            return
        n, rest = group.column("n").to_numpy(), group.column("rest").to_numpy() * (100 + percent)
        marks = [group.column(c).to_numpy() for c in ("marks2", "marks3")]
        outline = np.frombuffer(b"".join(group.column("outline").to_pylist()), "<u4").reshape(-1, CLASSES).astype(np.int32)
        tokens = group.column("tokens")
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(tokens[i].as_py(), "<i8")
            return sets[i]

        for i in one.tolist():
            ok = (root[other] != root[i]) & (marks[0][other] & marks[0][i] != 0) & (marks[1][other] & marks[1][i] != 0)
            both = (n[other] + n[i]) * percent
            ok &= (rest[other] >= both) & (rest[i] >= both)
            if other is one:
                ok &= other > i
            at = other[ok]
            if not len(at):
                continue
            spare = np.minimum(outline[at], outline[i]).sum(1) * (100 + percent) - (n[at] + n[i]) * percent
            for j in at[np.argsort(-spare, kind="stable")][: int((spare >= 0).sum())].tolist():
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if 100 * both >= percent * (int(n[i]) + int(n[j]) - both):
                    root[root == root[j]] = root[i]
                    yield (int(names[i]), int(names[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        seen: set[tuple[int, int]] = set()

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            seen.update(links(table))
            if len(seen) > 20_000:
                yield flush()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.int64())], schema=_pairs)
            seen.clear()
            return out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("list", "lo", "hi")])
            cut = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1) if table.num_rows else np.zeros(1, int)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield from done(table.slice(lo, hi - lo))
            rest = table.slice(int(cut[-1]))
        if rest is not None and rest.num_rows:
            yield from done(rest)
        if seen:
            yield flush()

    return run


def _dealt(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of long lists as (list, lo, hi, side, node, component, n, rest, marks2, marks3), in chunks that meet two by two; and two stashed tables behind it.

    Chunks hold documents of one size class, and of one component or of small ones. Chunks of one large component don't
    meet, nor do those whose sizes and remaining tokens exclude every pair of theirs. A document goes to a pair of chunks
    only if its own remaining tokens can be enough for the least of the other chunk.
    """
    large = rows.groupBy("list", "component").agg(F.count("*").alias("_inside")).filter(F.col("_inside") * 2 >= CHUNK).select("list", "component", F.col("component").alias("own"))
    # both joins' small sides stand there for each salt, so that one component's documents spread over several tasks
    salt = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(SALTS)).cast("int")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", salt).join(salted(large), ["list", "component", "salt"], "left").withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(STEP))).cast("int"))
    cells = rows.groupBy("list", "own", "size_class").agg(F.count("*").alias("_inside"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    cells = stash(cells.withColumn("chunks", F.ceil(F.col("_inside") / CHUNK).cast("int")), "cells")
    key = lambda sub: F.xxhash64("list", F.coalesce("own", F.lit(-1)), "size_class", sub)
    sizes = salted(cells.select(F.col("list").alias("_l"), F.col("own").alias("_o"), F.col("size_class").alias("_c"), "chunks")).withColumnRenamed("salt", "_s")
    placed = rows.join(sizes, (F.col("list") == F.col("_l")) & (F.col("salt") == F.col("_s")) & F.col("own").eqNullSafe(F.col("_o")) & (F.col("size_class") == F.col("_c")))
    placed = placed.withColumn("unit", key(F.pmod(F.xxhash64("node", F.lit(99)), F.col("chunks")).cast("int"))).select("list", "unit", "node", "component", "n", "rest", "marks2", "marks3")

    units = cells.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("unit", key(F.col("sub"))).select("list", "unit", "own", "size_class", "least", "most", "rest")
    far = math.ceil(math.log(100 / percent) / math.log(STEP)) + 1
    one = units.withColumn("met_class", F.explode(F.sequence(F.col("size_class"), F.col("size_class") + far)))
    other = units.select("list", F.col("size_class").alias("met_class"), *(F.col(c).alias(f"{c}_") for c in ("unit", "own", "least", "most", "rest")))
    pairs = one.join(other, ["list", "met_class"]).filter((F.col("size_class") < F.col("met_class")) | (F.col("unit") <= F.col("unit_")))
    pairs = pairs.filter(~F.coalesce(F.col("own") == F.col("own_"), F.lit(False)) & (F.col("most") * 100 >= F.col("least_") * percent) & (F.col("most_") * 100 >= F.col("least") * percent))
    pairs = pairs.filter(F.least("rest", "rest_") * (100 + percent) >= (F.col("least") + F.col("least_")) * percent)
    pairs = stash(pairs.select("list", F.col("unit").alias("lo"), F.col("unit_").alias("hi"), F.col("least").alias("lo_least"), F.col("least_").alias("hi_least")), "units")

    def side(which: int, mine: str, theirs: str) -> DataFrame:
        met = pairs.withColumn("unit", F.col(mine)).withColumn("_theirs", F.col(theirs))
        met = met if not which else met.filter("lo <> hi")
        enough = F.col("rest") * (100 + percent) >= (F.col("n") + F.col("_theirs")) * percent
        return placed.join(met, ["list", "unit"]).filter(enough).select("list", "lo", "hi", F.lit(which).alias("side"), "node", "component", "n", "rest", "marks2", "marks3")

    return side(0, "lo", "hi_least").unionByName(side(1, "hi", "lo_least")), cells, pairs


def _apart(here: DataFrame, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of a token in different components."""
    # of tokens with the same documents the first in the order: no pair meets first under one of the others
    lists = open_.groupBy("list1", "list2", "size").agg(F.min(F.struct("first", "token")).alias("t")).select(F.col("t.token").alias("list"), "size")
    rows = here.join(lists, F.col("token") == F.col("list")).select("list", "size", "node", "component", "n", (F.col("n") - F.col("pos")).alias("rest"), "marks2", "marks3")
    rows = stash(rows, "members")
    long = _dealt(rows.filter(F.col("size") > CHUNK).drop("size"), percent)
    short = rows.filter(F.col("size") <= CHUNK).select("list", F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), F.lit(0).alias("side"), "node", "component", "n", "rest", "marks2", "marks3")
    met = short.unionByName(long[0])
    met = met.join(sets.select("node", "tokens").mapInArrow(_outline, OUTLINES), "node")
    met = met.select("list", "lo", "hi", "side", "node", "component", "n", "rest", "marks2", "marks3", "outline", "tokens")
    dealt = met.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi", "side")
    links = stash(dealt.mapInArrow(_blocks(percent), "a bigint, b bigint"), "links")
    for known in (rows, *long[1:]):
        release(known)
    return links


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (id, component) after more links (a, b): only the links between components are followed."""
    if component is None:
        return stash(connected_components(links), "components")
    name = lambda side: component.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    lifted = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = stash(connected_components(lifted.filter("a <> b")), "components")
    moved = component.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    new = roots.join(component, "id", "left_anti").select("id", "component")
    return stash(moved.unionByName(new), "components")


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose shingle sets have a Jaccard similarity of ``percent`` of 100 or more.

    Returns one row for each input row: doc_id, n_shingles (size of the set) and component_id (the smallest doc_id
    that links reach, the row's own included). A document without words, or null, has an empty set and links with
    nothing, also not with other empty ones. Rows that repeat a doc_id are documents of their own that share an id.
    Of other columns only doc_id and text are read. ``docs`` should be a table read from files: a block's documents
    are told apart by their places in the input's partitions.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    buckets = max(64, 8 * own.rdd.getNumPartitions())
    parts = own.mapInArrow(_cut(words, buckets), PARTS)
    shared = parts.groupBy("key").applyInArrow(_shared, PARTS)
    full = stash(shared.groupBy("block").applyInArrow(_gathered(percent), DOCS), "sets")
    table = stash(full.select("doc_id", "n", "d1", "d2"), "documents")
    tidy(docs.sparkSession)

    key = F.concat(F.hex("d1"), F.lit("-"), F.hex("d2"), F.lit("-"), F.col("n").cast("string"))
    members = table.filter("n > 0").select(key.alias("key"), "doc_id")
    classes = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    one = full.filter("tokens is not null").groupBy(key.alias("key")).agg(F.first("n").alias("n"), F.max(F.struct("tokens", "classes")).alias("s"))
    # the numbers are fixed by being written: what reads them later sees the same ones
    sets = stash(one.select("key", F.monotonically_increasing_id().alias("node"), "n", "s.tokens", "s.classes"), "classes")
    release(full)  # one set of each class is enough
    postings = stash(sets.select("node", "n", "tokens", "classes").mapInArrow(_post(percent), POSTINGS), "postings")

    component = None
    for turn in range(3):
        here = postings.withColumn("component", F.col("node"))
        if component is not None:
            here = stash(postings.join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "postings")
        # first a star around any document, then one around the smallest set: what it can't reach, larger ones can't by size
        by = F.xxhash64("node") if turn == 0 else F.col("n")
        which = F.struct(by.alias("by"), "node", "n", "s", "marks2", "marks3", "component")
        open_ = here.groupBy("token").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(which).alias("lead"), F.count("*").alias("size"), F.min("pos").alias("first"),
            F.bit_xor(F.xxhash64("node")).alias("list1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("list2"),
        ).filter("lo <> hi")
        if turn < 2:
            lead = open_.select("token", *(F.col(f"lead.{c}").alias(f"{c}_") for c in ("node", "n", "s", "marks2", "marks3", "component")))
            pairs = here.join(lead, "token").filter("component <> component_").filter(_could(percent))
            pairs = pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()
            links = _links(sets, pairs, percent).filter("linked").select("a", "b")
        else:
            links = _apart(here, open_, sets, percent)
        before, component = component, _merged(component, links)
        # the components are written: what led to them is spent
        for known in [links, *([] if before is None else [here, before])]:
            release(known)
        tidy(docs.sparkSession)
    release(postings)

    joined = classes.join(sets.select("key", "node"), "key", "left").join(component.withColumnRenamed("id", "node"), "node", "left")
    joined = stash(joined.filter("size > 1 or component is not null").select("key", "least", "component"), "classes")
    for known in (sets, component):  # what follows reads only the two tables that are left
        release(known)
    low = joined.filter("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    ids = joined.join(low, "component", "left").select(F.col("key"), F.coalesce("low", "least").alias("_least"))
    out = table.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, key).alias("key")).join(ids, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component, with all their columns.

    Documents without words stay. Rows that repeat a doc_id stand for one document: they stay or go together.
    """
    gone = jaccard_components(docs, words=words, percent=percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("_gone"), "left_anti")
