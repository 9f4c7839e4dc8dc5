"""Reading columns of Arrow batches, and running a function over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.shared import ship


_FLAT = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def flat_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of plain columns; unlike Spark's own parser it needs no session."""
    return pa.schema([(name, _FLAT[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def per_row(df: DataFrame, inputs: list[str], schema: str, fn: Callable[[list], list[tuple]]) -> DataFrame:
    """Applies ``fn`` to lists of rows (tuples of the ``inputs``), a batch at a time; it returns as many output rows.

    ``fn`` must depend on nothing but its rows, so a task that is run again gives the same rows.
    """
    ship(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = fn(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, out)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into pieces of about ``most_bytes``; a single row is never cut."""
    n = batch.num_rows
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def text_of(column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
