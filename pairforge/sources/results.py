"""Configurations, lookups and the results of earlier runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.sources.checks import CheckFailed, need_unique


def load_config(path: str, defaults: Mapping | None = None) -> dict:
    """A JSON configuration over defaults: objects merge, all else replaces."""

    def merged(base: Mapping, over: Mapping) -> dict:
        return {**base, **{k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}}

    return merged(defaults or {}, json.loads(Path(path).read_text(encoding="utf-8")))


def write_json(value, path: str) -> None:
    """A summary as JSON, with keys as given and a line end."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def ordered_union(*lists: Sequence[str]) -> list[str]:
    """All names of several lists, each where it first comes."""
    return list(dict.fromkeys(x for names in lists for x in names))


def resolved_features(views: Mapping[str, Sequence[str]], wanted: Sequence[str], extra: Sequence[str] = (), without: Sequence[str] = ()) -> list[str]:
    """The features of the wanted views and the extra ones, each once and in order, without the named ones; an unknown view is an error."""
    if unknown := [v for v in wanted if v not in views]:
        raise KeyError(f"unknown feature views: {unknown}")
    return [f for f in ordered_union(*(views[v] for v in wanted), extra) if f not in set(without)]


def allowed_name(name: str, allow: Sequence[str], deny: Sequence[str]) -> bool:
    """Whether a name has one of the allowed beginnings (any, if there are none) and none of the denied ones."""
    return (not allow or name.startswith(tuple(allow))) and not (deny and name.startswith(tuple(deny)))


def eligible_lookup(manifest: DataFrame, buckets: Sequence[str], keys: Sequence[str], bucket: str = "data_bucket") -> DataFrame:
    """The manifest's rows of the given buckets, one for each key; a key that repeats is an error."""
    out = manifest.filter(F.col(bucket).isin(*buckets))
    need_unique(out.withColumn("_key", F.concat_ws("|", *(F.col(k).cast("string") for k in keys))), "_key")
    return out


def with_raw_rows(lookup: DataFrame, raw: DataFrame, source: str, row: str) -> DataFrame:
    """Eligible rows beside their raw rows, by source and row number; raw columns of the same name are left out."""
    own = raw.select(source, row, *(c for c in raw.columns if c not in lookup.columns))
    return lookup.join(own, [source, row])


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): each non-blank key in lower case with its distinct non-blank values, sorted."""
    own = rows.select(F.lower(F.trim(key)).alias("key"), F.trim(value).alias("value")).filter("key <> '' and value <> ''")
    return own.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def score_map(rows: DataFrame, key: str, score: str, offset: float = 0.0) -> DataFrame:
    """(key, score) of a feature or prediction table: rows without a finite score are left out, a repeated key is an error."""
    if score not in rows.columns:
        raise CheckFailed(f"no column {score}")
    own = rows.select(F.col(key).alias("key"), (F.col(score).try_cast("double") + offset).alias("score")).filter("score is not null and not isnan(score) and abs(score) < double('infinity')")
    return need_unique(own, "key")


def run_scores(runs: Mapping[str, DataFrame], key: str, score: str) -> DataFrame:
    """(key, scorer, score) of several runs at once."""
    out = None
    for name, rows in runs.items():
        own = rows.select(F.col(key).alias("key"), F.lit(name).alias("scorer"), F.col(score).cast("double").alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def found_summaries(folder: str, pattern: str, archive: str | None = None) -> list[str]:
    """Summary files of a pattern, newest name last; an archive is looked through only if the folder has none."""
    here = sorted(str(p) for p in Path(folder).glob(pattern))
    return here or (sorted(str(p) for p in Path(archive).rglob(pattern)) if archive and Path(archive).exists() else [])


def context_fingerprint(paths: Sequence[str]) -> str:
    """The SHA-256 of the records (name, bytes, digest) of files, in the order of names; a missing file counts as such."""
    listed = []
    for path in sorted(paths):
        p = Path(path)
        listed.append([p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()] if p.exists() else [p.name, None, None])
    return hashlib.sha256(json.dumps(listed).encode()).hexdigest()


def merged_summary(old: Mapping | None, new: Mapping, context: str = "context", runs: str = "runs") -> tuple[dict, bool]:
    """A run's summary over an earlier one: runs of equal context merge by name, another context replaces all.

    The second value says whether the earlier one should be backed up.
    """
    if old is None or old.get(context) != new.get(context):
        return dict(new), old is not None
    return {**old, **new, runs: {**old.get(runs, {}), **new.get(runs, {})}}, False


def resolved_scorer(runs: Sequence[Mapping], family: str, run: str | None = None) -> Mapping:
    """The run of a family that is named, or the family's best by AUC, then average precision, then name; an error without one."""
    own = [r for r in runs if r["family"] == family and (run is None or r["run"] == run)]
    if not own:
        raise KeyError(f"no run {run or ''} of {family}")
    return min(own, key=lambda r: (-(r.get("auc") or 0.0), -(r.get("average_precision") or 0.0), r["run"]))


def missing_inputs(paths: Mapping[str, str], modules: Sequence[str] = ()) -> list[str]:
    """The names of files that are not there or empty, and of modules that can't be imported."""
    import importlib.util

    gone = [n for n, p in paths.items() if not Path(p).exists() or (Path(p).is_file() and not Path(p).stat().st_size)]
    return gone + [m for m in modules if importlib.util.find_spec(m) is None]


def grid(**axes: Sequence) -> list[dict]:
    """All settings of an experiment: one for each combination, the last axis fastest."""
    out: list[dict] = [{}]
    for name, values in axes.items():
        out = [{**one, name: v} for one in out for v in values]
    return out


def merged_columns(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``old`` with the columns' new values where there are any; rows and values that are only old stay."""
    fresh = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = old.join(fresh, key, "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns), *(F.col(f"_{c}").alias(c) for c in columns if c not in old.columns))


def core_eligible(rows: DataFrame, usable: str) -> tuple[DataFrame, int]:
    """The rows that are marked as usable, and how many were not."""
    ok = F.coalesce(F.col(usable).cast("boolean"), F.lit(False))
    return rows.filter(ok), rows.filter(~ok).count()


def read_config_table(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A configuration's list of objects as a table; missing fields are null."""
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
