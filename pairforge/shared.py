"""Writing intermediate tables where every executor can read them back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one that the context was given.

    Only in a local session, as in tests, a temporary folder stands in for an unset one: on a cluster other machines could
    not read what is written there.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairforge-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application, for functions that run in Python."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="pairforge-")) / "pairforge.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, Path(top.name) / file.relative_to(top))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the table read back.

    This cuts the lineage: a later stage that loses an executor reads the files again. The files are removed when
    the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Removes the files behind a stashed table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        for entry in [e for e in _written if e[1].split("://")[-1].split(":")[-1].lstrip("/") in file]:
            _remove(entry)
            _written.remove(entry)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark removes the shuffle files of plans that are gone only then.

    For long jobs of many steps, after a step whose shuffles were large.
    """
    spark.sparkContext._jvm.System.gc()


def _remove(entry: tuple[SparkSession, str]) -> None:
    spark, path = entry
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for entry in _written:
        try:
            _remove(entry)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
