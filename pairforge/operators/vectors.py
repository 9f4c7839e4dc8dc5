"""Nearest neighbours of dense vectors, exact, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.shared import ship

#: Vectors of a chunk; two chunks meet in a task.
CHUNK = 2048
_found = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])


def likeness(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All pairs' cosines, or their squared distances with the sign turned."""
    dots = a @ b.T
    if metric == "cosine":
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return 2 * dots - (a * a).sum(1)[:, None] - (b * b).sum(1)


def best_of(ids: np.ndarray, mine: np.ndarray, others: np.ndarray, theirs: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each id its k best among the others as columns of (src, dst, score), strips at a time.

    Scores that agree to nine places are ties, which go to the lesser id.
    """
    order = np.argsort(others, kind="stable")
    others, theirs = others[order], theirs[order]
    step = max(1, (1 << 21) // max(len(others), 1))
    for at in range(0, len(ids), step):
        score = likeness(mine[at : at + step], theirs, metric)
        score[ids[at : at + step, None] == others] = -np.inf
        top = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
        kept = np.take_along_axis(score, top, 1)
        src = np.repeat(ids[at : at + step], top.shape[1])
        there = np.isfinite(kept).ravel()
        yield src[there], others[top].ravel()[there], kept.ravel()[there]


def nearest(vectors: DataFrame, key: str, vector: str, k: int, *, by: str | None = None, metric: str = "cosine") -> DataFrame:
    """Each vector's k nearest others of the same ``by``: (src, dst, score, rank), ties to the lesser dst.

    ``metric`` is "cosine" or "distance", whose score is the squared distance with the sign turned. Vectors are dealt
    into chunks by a hash; every two chunks of a group meet in a task, which keeps each vector's k best of that meeting.
    So the result is exact, its size is linear, and the work is that of all pairs of a group in matrix products: a group
    of very many vectors should be divided by ``by`` first. Rows without a key or a vector are left out; keys are whole
    numbers and unique.
    """
    ship(vectors.sparkSession)
    group = F.col(by) if by else F.lit(0)
    own = vectors.select(F.hash(group).alias("_g"), group.alias("_by"), F.col(key).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).filter("_id is not null and _v is not null")
    sizes = own.groupBy(F.col("_by").alias("_b")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    placed = own.join(sizes, F.col("_by").eqNullSafe(F.col("_b"))).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    met = met.select("_by", F.least("_chunk", "_other").alias("_lo"), F.greatest("_chunk", "_other").alias("_hi"), (F.col("_chunk") > F.col("_other")).alias("_second"), "_id", "_v")

    def compare(table: pa.Table) -> pa.Table:
        second = table.column("_second").to_numpy()
        ids = table.column("_id").to_numpy()
        flat = np.concatenate([np.asarray(x.as_py(), float) for x in table.column("_v")]).reshape(len(ids), -1)
        one = (ids[~second], flat[~second])
        sides = [(one, (ids[second], flat[second])), ((ids[second], flat[second]), one)] if second.any() else [(one, one)]
        parts = [p for mine, theirs in sides for p in best_of(*mine, *theirs, k, metric)]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _found, strict=True)], schema=_found)

    found = met.groupBy("_by", "_lo", "_hi").applyInArrow(compare, "src bigint, dst bigint, score double")
    w = Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_pairs(vectors: DataFrame, key: str, vector: str, k: int, *, by: str | None = None) -> DataFrame:
    """Pairs (a, b, score), a < b, of which one is among the other's k nearest by cosine; scores to six places."""
    found = nearest(vectors, key, vector, k, by=by)
    return found.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.round("score", 6).alias("score")).groupBy("a", "b").agg(F.max("score").alias("score"))
