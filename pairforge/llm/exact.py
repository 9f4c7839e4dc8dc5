"""Exact dedup by a tree merge of sorted digest runs.

Each task of the first step makes sorted runs of distinct digests, each with the kept identifier and a count. The tasks
are the leaves of a binomial exchange with a fan of 8: in round r a node sends each entry to the node whose digit r is
that of the digest, so that after r rounds it holds what 8^r leaves have of its share of the digest space. Runs travel
packed, a row for each run and receiver. Every node merges the sorted runs it gets in one multiway pass and keeps one
entry for each digest, the largest identifier among them; digests are compared in full, 256 bits. After the last round
each digest is on one node, whatever its number of copies. Where leaves hold many rows, every node is divided into lanes
by other bits of the digest, so that a node's runs stay within a bound. The way back goes by the parts of the input:
each part's entry is told the result, then the rows of the part.

Texts are equal when identical after lower-casing A-Z only. Null counts as the empty text; all empty texts form a
group. Of a group the row with the largest doc_id stays; null ids come last, and rows that repeat the kept id are all
reported as kept. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.rows import flat_schema, slices, text_of
from pairforge.shared import ship, stash

FAN = 8
#: Entries of a run, and of what a node gets in a round on average.
RUN_ROWS = 1 << 17
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS = "leaf bigint, doc_id bigint, digest binary"
RUNS = "node bigint, digests binary, keeps binary, sizes binary"
MERGED = "digest binary, keep bigint, size bigint"
_rows, _runs, _merged = flat_schema(ROWS), flat_schema(RUNS), flat_schema(MERGED)
#: Stands for a missing identifier: it is less than all others.
NO_ID = np.iinfo(np.int64).min
#: A sorted run: its digests one after another, the kept identifiers, the numbers of rows.
Run = tuple[bytes, np.ndarray, np.ndarray]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaf = TaskContext.get().partitionId()
    for batch in batches:
        for part in slices(batch):
            digests = [hashlib.sha256(x.as_buffer().to_pybytes().translate(_LOWER)).digest() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(digests), pa.int64()), part.column(0), pa.array(digests, pa.binary())], schema=_rows)


def _entries(run: Run) -> Iterator[tuple[bytes, int, int]]:
    digests, keeps, sizes = run
    return zip([digests[i : i + 32] for i in range(0, len(digests), 32)], keeps.tolist(), sizes.tolist(), strict=True)


def merge_runs(runs: list[Run]) -> Run:
    """One sorted run of several in a multiway pass: equal digests become one entry with the largest id and the sum of sizes."""
    digests: list[bytes] = []
    keeps: list[int] = []
    sizes: list[int] = []
    last = None
    for digest, keep, size in heapq.merge(*map(_entries, runs), key=itemgetter(0)):
        if digest == last:
            sizes[-1] += size
            if keep > keeps[-1]:
                keeps[-1] = keep
        else:
            digests.append(digest)
            keeps.append(keep)
            sizes.append(size)
            last = digest
    return b"".join(digests), np.array(keeps, np.int64), np.array(sizes, np.int64)


def _sent(run: Run, node: int, turn: int, width: int, lanes: int) -> Iterator[tuple]:
    """The parts of a run for their receivers in the exchange's round ``turn``: digit ``turn`` of the node becomes the digest's."""
    digests, keeps, sizes = run
    entries = np.frombuffer(digests, "S32")
    bits = np.frombuffer(digests, ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
    step = FAN**turn
    digit = (bits >> np.uint64(3 * turn)).astype(np.int64) & (FAN - 1)
    lane = ((bits >> np.uint64(40)) % np.uint64(lanes)).astype(np.int64)
    here = node % width
    to = lane * width + here - here // step % FAN * step + digit * step
    for receiver in np.unique(to).tolist():
        own = to == receiver
        yield receiver, entries[own].tobytes(), keeps[own].astype("<i8").tobytes(), sizes[own].astype("<i8").tobytes()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, _runs, strict=True)], schema=_runs)


def _leaves(width: int, lanes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() % width
        digests, keeps = [], []

        def sent() -> pa.RecordBatch:
            order = sorted(range(len(digests)), key=digests.__getitem__)
            one = b"".join([digests[i] for i in order]), np.array(keeps, np.int64)[order], np.ones(len(order), np.int64)
            digests.clear()
            keeps.clear()
            return _packed(list(_sent(merge_runs([one]), node, 0, width, lanes)))

        for batch in batches:
            digests += batch.column(1).to_pylist()
            keeps += [NO_ID if i is None else i for i in batch.column(0).to_pylist()]
            if len(digests) >= RUN_ROWS:
                yield sent()
        if digests:
            yield sent()

    return run


def _received(table: pa.Table) -> Run:
    columns = zip(*(table.column(c).to_pylist() for c in ("digests", "keeps", "sizes")), strict=True)
    return merge_runs([(d, np.frombuffer(k, "<i8"), np.frombuffer(n, "<i8")) for d, k, n in columns])


def _passed_on(turn: int, width: int, lanes: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        return pa.Table.from_batches([_packed(list(_sent(_received(table), node, turn, width, lanes)))], schema=_runs)

    return run


def _finished(table: pa.Table) -> pa.Table:
    """The merged entries of more than one row."""
    digests, keeps, sizes = _received(table)
    some = np.flatnonzero(sizes > 1)
    listed = pa.array([digests[32 * i : 32 * i + 32] for i in some.tolist()], pa.binary())
    return pa.Table.from_arrays([listed, pa.array(keeps[some], pa.int64(), mask=keeps[some] == NO_ID), pa.array(sizes[some])], schema=_merged)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text's UTF-8)."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"))
    rows = stash(own.mapInArrow(_digests, ROWS), "digests")
    leaves = max(1, rows.rdd.getNumPartitions())
    lanes = max(1, -(-rows.count() // (leaves * RUN_ROWS)))
    rounds = 1
    while FAN**rounds < leaves:
        rounds += 1
    width = FAN**rounds
    runs = rows.select("doc_id", "digest").mapInArrow(_leaves(width, lanes), RUNS)
    for turn in range(1, rounds):
        runs = runs.groupBy("node").applyInArrow(_passed_on(turn, width, lanes), RUNS)
    merged = runs.groupBy("node").applyInArrow(_finished, MERGED).select("digest", F.col("keep").alias("_keep"), F.col("size").alias("_size"))
    told = rows.groupBy("leaf", "digest").agg(F.count("*").alias("_here")).join(merged, "digest").select("leaf", "digest", "_keep", "_size")
    out = rows.join(told, ["leaf", "digest"], "left")
    alone = F.col("_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: The same for ``documents`` in DuckDB's SQL.
ORACLE = """
with n as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from n group by h)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, n.h as text_sha256 from n join g using (h)
"""
