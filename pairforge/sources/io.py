"""Reading and writing tables: CSV, JSON lines, SQL dumps, HTML pages, worksheets, and keyed caches."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, line_ends_in_values: bool = True) -> DataFrame:
    """A CSV file with a header, all columns as text; a byte order mark is understood.

    Quoted line ends need a file to be read by one task. Without ``line_ends_in_values`` large files are cut into parts.
    """
    reader = spark.read.option("header", True).option("multiLine", line_ends_in_values).option("escape", '"').option("encoding", "UTF-8")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    out = reader.csv(path)
    return out.toDF(*(c.removeprefix("\ufeff") for c in out.columns))


def _flat(df: DataFrame, column: str):
    kind = dict(df.dtypes).get(column)
    if kind is None:
        return F.lit("").alias(column)
    return F.to_json(column).alias(column) if kind.startswith(("array", "map", "struct")) else F.col(column)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], *, tolerant: bool = False) -> None:
    """Writes the named columns. A column that is not named is an error; with ``tolerant``, missing ones are empty.

    Nested columns become JSON.
    """
    extra = set(df.columns) - set(columns)
    if extra and not tolerant:
        raise ValueError(f"columns that the file does not have: {sorted(extra)}")
    df.select(*(_flat(df, c) for c in columns)).write.option("header", True).option("escape", '"').csv(path)


def write_union_csv(tables: Sequence[DataFrame], path: str) -> list[str]:
    """Writes several tables as one, with all their columns in the order in which they first come; returns these.

    What a table lacks is empty, nested columns become JSON.
    """
    columns = list(dict.fromkeys(c for t in tables for c in t.columns))
    out = None
    for t in tables:
        own = t.select(*(_flat(t, c).cast("string").alias(c) for c in columns))
        out = own if out is None else out.unionByName(own)
    out.write.option("header", True).option("escape", '"').csv(path)
    return columns


def write_sorted_buckets(df: DataFrame, path: str, bucket: str, order: Sequence[str]) -> None:
    """Writes CSV files in a folder for each bucket, each bucket's rows in order over its files' names.

    Rows are dealt by ranges of bucket and order, so a large bucket has several files and no task holds it all.
    """
    df.repartitionByRange(bucket, *order).sortWithinPartitions(bucket, *order).write.partitionBy(bucket).option("header", True).option("escape", '"').csv(path)


class BrokenLine(ValueError):
    """A line that holds no JSON object, with its place."""


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a known schema; a broken line is an error, blank ones are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def need_json_lines(spark: SparkSession, path: str) -> None:
    """Raises with the file and the number of the first line that is no JSON object; blank lines are no error.

    Lines are looked at in parts; the number is counted only in a file that has a broken one.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    bad = lines.filter(F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{")).select(F.min("file")).first()[0]
    if bad is not None:
        rows = spark.read.text(bad, wholetext=True).first()[0].split("\n")
        for number, line in enumerate(rows, 1):
            try:
                found = json.loads(line) if line.strip() else {}
            except ValueError:
                found = None
            if not isinstance(found, dict):
                raise BrokenLine(f"{bad}, line {number}")


def write_json_lines(df: DataFrame, path: str, bucket: str | None = None) -> None:
    writer = df.write
    (writer.partitionBy(bucket) if bucket else writer).json(path)


def read_sql_dump(spark: SparkSession, path: str, pattern: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Value rows of an SQL dump: lines that begin with "(" and match ``pattern``, one column for each group.

    ``columns`` are names and types; '' inside quoted values stands for one quote.
    """
    lines = spark.read.text(path).filter(F.col("value").startswith("(") & F.col("value").rlike(pattern))
    one = lambda i, kind: F.regexp_replace(F.regexp_extract("value", pattern, i), "''", "'").try_cast(kind)
    return lines.select(*(one(i, kind).alias(name) for i, (name, kind) in enumerate(columns, 1)))


def insert_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first INSERT of a dump."""
    row = spark.read.text(path).filter(F.col("value").rlike(r"(?i)^insert into .*\(")).select(F.regexp_extract("value", r"(?i)^insert into [^(]*\(([^)]*)\)", 1)).first()
    return [c.strip(" `\"[]") for c in row[0].split(",")] if row else []


def read_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as (file_name, html), one row each."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("html"))


class WorksheetSource(DataSource):
    """The first worksheet of XLSX files: spark.read.format("worksheet").load(path). All columns are text."""

    @classmethod
    def name(cls) -> str:
        return "worksheet"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in worksheet_header(self.options["path"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _WorksheetReader(self.options["path"], schema)


class _WorksheetReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = worksheet_rows(partition.value)
        next(rows, None)
        width = len(self.schema)
        for row in rows:
            yield tuple((row + [None] * width)[:width])


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def worksheet_rows(path: str) -> Iterator[list[str | None]]:
    """Rows of the first worksheet, read as a stream; shared and inline strings are resolved, empty cells are None."""
    with zipfile.ZipFile(path.removeprefix("file:")) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        sheet = _first_sheet(book)
        with book.open(sheet) as file:
            for _, node in ET.iterparse(file):
                if node.tag != f"{_NS}row":
                    continue
                row: list[str | None] = []
                for cell in node.iter(f"{_NS}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    value = cell.findtext(f"{_NS}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    row[at] = value
                yield row
                node.clear()


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The file of the sheet that the workbook lists first; without a list, that of the lowest number."""
    names = book.namelist()
    try:
        listed = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
        wanted = listed.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")
        for link in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if link.get("Id") == wanted:
                target = link.get("Target", "")
                path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if path in names:
                    return path
    except (KeyError, AttributeError, ET.ParseError):
        pass
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def _column(place: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", place)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def worksheet_header(path: str) -> list[str]:
    return [c or f"column_{i}" for i, c in enumerate(next(worksheet_rows(path), []), 1)]


def read_vectors(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame | None:
    """A cache of vectors, if it holds exactly the wanted keys; else None."""
    try:
        cached = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    same = cached.select(key).exceptAll(wanted.select(key)).isEmpty() and wanted.select(key).exceptAll(cached.select(key)).isEmpty()
    return cached if same else None


def write_vectors(vectors: DataFrame, path: str, key: str) -> str:
    """Writes a cache of vectors and, beside it, a digest of its keys; returns that. ``read_vectors`` takes it back."""
    vectors.write.mode("overwrite").parquet(path)
    return table_fingerprint(vectors, [key])


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest of a table's rows whatever their order: sums of row hashes and the number of rows."""
    cols = list(columns or df.columns)
    row = F.xxhash64(F.to_json(F.struct(*cols)))
    one = df.agg(F.sum(row.cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("t"), F.count("*").alias("n")).first()
    import hashlib

    return hashlib.sha256(f"{cols}|{one['s']}|{one['t']}|{one['n']}".encode()).hexdigest()


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table; larger tables are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |"]
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in r)} |" for r in rows])
