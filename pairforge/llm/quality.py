"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in a cycle; each step fits a tree of a few leaves on
one feature's histogram of gradients and adds it to that feature's lookup table. When the single features are
learned, the pairs that explain most of what is left get two-dimensional tables in the same way. A score is the sum
of looked-up values, taken for all rows of a block at once.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.rows import per_row, slices, text_of
from pairforge.shared import ship

#: What a text is described by; nothing but the text goes in.
FEATURES = [
    "log_words", "word_length", "distinct_words", "top_word", "repeated_words", "repeated_pairs", "upper", "digits", "symbols", "stops",
    "bars", "spaces", "capital_words", "marked_words", "log_lines", "repeated_lines", "words_a_line", "line_ends", "longest_word", "no_letters",
]

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:256] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP)
_SYMBOL[:33] = False
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _STOP, _SPACE, _UPPER | _LOWER]).astype(np.float64)
_BAR = ord("|")


def describe(text: str) -> list[float]:
    """The features of a text. Shares of nothing are 0, so the empty text is all zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x]
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, digits, symbols, stops, spaces, letters = (_CLASSES @ counts).tolist()
    size = len(raw)
    each = Counter(words)
    distinct = len(each)
    place = dict(zip(each, range(distinct), strict=True))
    at = np.fromiter(map(place.__getitem__, words), np.int64, n)
    pairs = len(np.unique(at[:-1] * distinct + at[1:]))
    return [
        float(np.log1p(n)), (size - spaces) / n, distinct / n, max(each.values()) / n, sum(map(operator.eq, words, words[1:])) / n, 1 - pairs / (n - 1) if n > 1 else 0.0,
        upper / max(letters, 1), digits / size, symbols / size, stops / n, counts[_BAR] / n, spaces / size, sum(map(str.istitle, each)) / distinct,
        1 - sum(map(str.isalpha, each)) / distinct, float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), n / len(lines),
        sum(x[-1] in ".!?" for x in lines) / len(lines), float(np.log1p(max(map(len, each)))), 1 - letters / size,
    ]


@dataclass
class Additive:
    """Lookup tables: for each feature its cuts and values, for each pair of features coarser cuts and a grid."""

    base: float
    cuts: list[np.ndarray]
    values: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.values, strict=True)):
            total += values[np.searchsorted(cuts, x[:, j], "right")]
        if self.pairs:
            bins = [np.searchsorted(cuts, x[:, j], "right") for j, cuts in enumerate(self.coarse)]
            for (a, b), grid in zip(self.pairs, self.grids, strict=True):
                total += grid[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray, most: int) -> np.ndarray:
    """Places between values, at about equal numbers of rows."""
    return np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1], method="inverted_cdf"))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smooth: float) -> tuple[np.ndarray, float]:
    """The best tree of at most ``leaves`` leaves over ordered bins, grown a split at a time: its values and gain."""
    g, h = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))
    part = [(0, len(grad))]
    gained = 0.0
    worth = lambda a, b: a * a / (b + smooth)
    for _ in range(leaves - 1):
        best = (1e-9, 0, 0)
        for k, (lo, hi) in enumerate(part):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            gain = worth(g[at] - g[lo], h[at] - h[lo]) + worth(g[hi] - g[at], h[hi] - h[at]) - worth(g[hi] - g[lo], h[hi] - h[lo])
            i = int(gain.argmax())
            best = max(best, (float(gain[i]), k, int(at[i])))
        if not best[2]:
            break
        gain, k, cut = best
        lo, hi = part[k]
        part[k : k + 1] = [(lo, cut), (cut, hi)]
        gained += gain
    out = np.empty(len(grad))
    for lo, hi in part:
        out[lo:hi] = -(g[hi] - g[lo]) / (h[hi] - h[lo] + smooth)
    return out, gained


def _cross(grad: np.ndarray, hess: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four quarters: the quarters' values spread over the grid, and the gain."""
    g, h = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (grad, hess))
    rows, columns = grad.shape
    if rows < 2 or columns < 2:
        return np.zeros(grad.shape), 0.0
    quarters = lambda m: (
        m[1:-1, 1:-1], m[1:-1, -1:] - m[1:-1, 1:-1], m[-1:, 1:-1] - m[1:-1, 1:-1], m[-1, -1] - m[1:-1, -1:] - m[-1:, 1:-1] + m[1:-1, 1:-1]
    )
    worth = sum(a * a / (b + smooth) for a, b in zip(quarters(g), quarters(h), strict=True))
    r, c = np.unravel_index(int(worth.argmax()), worth.shape)
    parts = [-a[r, c] / (b[r, c] + smooth) for a, b in zip(map(lambda m: np.broadcast_to(m, worth.shape), quarters(g)), map(lambda m: np.broadcast_to(m, worth.shape), quarters(h)), strict=True)]
    out = np.empty(grad.shape)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = parts
    return out, float(worth[r, c]) - float(g[-1, -1] ** 2 / (h[-1, -1] + smooth))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, bins: int = 48, coarse_bins: int = 12, leaves: int = 4, rate: float = 0.1, smooth: float = 2.0) -> Additive:
    """Learns the tables by cyclic boosting on the logistic loss. Without both labels the score is a constant.

    That constant is 0.5 without rows, else the share of label 1 with one row of each label added.
    """
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], bins) if n else np.zeros(0) for j in range(width)]
    coarse = [_cuts(x[:, j], coarse_bins) if n else np.zeros(0) for j in range(width)]
    values = [np.zeros(len(c) + 1) for c in cuts]
    model = Additive(base, cuts, values, [], coarse, [])
    if not n or y.min() == y.max():
        return model
    place = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    margin = np.full(n, base)
    for _ in range(rounds):
        for j in range(width):
            p = 1 / (1 + np.exp(-margin))
            size = len(values[j])
            step, gain = _tree(np.bincount(place[j], p - y, size), np.bincount(place[j], p * (1 - p), size), leaves, smooth)
            if gain > 0:
                values[j] += rate * step
                margin += rate * step[place[j]]
    rough = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        flat = rough[a] * shape[1] + rough[b]
        p = 1 / (1 + np.exp(-margin))
        return flat, np.bincount(flat, p - y, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = {(a, b): _cross(*grid(a, b)[1:], smooth)[1] for a, b in combinations(range(width), 2)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            flat, grad, hess = grid(a, b)
            step, gain = _cross(grad, hess, smooth)
            if gain > 0:
                model.grids[k] += rate * step
                margin += rate * step.ravel()[flat]
    return model


def is_held_out(doc_id):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most_rows: int = 20_000) -> Additive:
    """Fits the model on at most ``most_rows`` labelled rows, taken in the order of a hash of their ids.

    That bound is the only sample here: fitted tables do not get better with more rows. Rows that are held out, whose
    label is not 0 or 1, or whose id is null are left out; of several labels for an id the least counts, and of several
    texts the one whose features come first, so that the model does not depend on the order of rows.
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # the bound above makes the broadcast side at most most_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).join(F.broadcast(own), "doc_id")
    found = per_row(rows, ["doc_id", "_label", "text"], "doc_id bigint, y int, x array<double>", lambda part: [(d, y, describe(t)) for d, y, t in part])
    kept = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    kept.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in kept]).reshape(len(kept), len(FEATURES)), np.array([r["y"] for r in kept], float))


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    One row for each input row; null texts count as empty and are scored too; a null id gives a null held_out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_rows=most_rows))

    def run(rows: list[tuple]) -> list[tuple]:
        if not rows:
            return []
        scores = model.value.score(np.array([describe(text) for _, text in rows]))
        return [(doc_id, s) for (doc_id, _), s in zip(rows, scores.tolist(), strict=True)]

    scored = per_row(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), ["doc_id", "text"], "doc_id bigint, score double", run)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns, in place (no shuffle).

    Null texts are scored as empty and stay null. No column is added, so none of the input's can clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_rows=most_rows))

    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [describe(t or "") for t in part.column(place).to_pylist()]
                if found:
                    yield part.filter(pa.array(model.value.score(np.array(found)) >= threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
