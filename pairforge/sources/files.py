"""Finding, backing up and archiving result files on the driver's file system."""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path


def newest(folder: str, pattern: str, fallback: str | None = None) -> str | None:
    """The file of a pattern that was changed last, ties to the greater name."""
    found = sorted(Path(folder).glob(pattern), key=lambda p: (p.stat().st_mtime, p.name))
    return str(found[-1]) if found else fallback


def backup(path: str) -> str | None:
    """Copies a file or folder beside itself, with the time in its name; None if there is nothing yet."""
    source = Path(path)
    if not source.exists():
        return None
    target = _free(source.with_name(f"{source.name}.{datetime.now():%Y%m%d-%H%M%S}.bak"))
    (shutil.copytree if source.is_dir() else shutil.copy2)(source, target)
    return str(target)


def _free(path: Path) -> Path:
    out, n = path, 1
    while out.exists():
        out, n = path.with_name(f"{path.name}.{n}"), n + 1
    return out


def sha256_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def snapshot(paths: Iterable[str], folder: str) -> str:
    """Copies files into a new folder with a manifest of sizes and digests; a missing file is an error."""
    target = _free(Path(folder))
    target.mkdir(parents=True)
    listed = []
    for path in map(Path, paths):
        shutil.copy2(path, target / path.name)
        listed.append({"name": path.name, "bytes": path.stat().st_size, "sha256": sha256_of(str(path))})
    (target / "manifest.json").write_text(json.dumps(listed, indent=1))
    return str(target)


def referenced(summaries: Iterable[str], suffix: str = ".csv") -> set[str]:
    """Names of files that JSON summaries mention anywhere."""

    def texts(value) -> Iterable[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            for v in value.values():
                yield from texts(v)
        elif isinstance(value, list):
            for v in value:
                yield from texts(v)

    return {Path(t).name for s in summaries for t in texts(json.loads(Path(s).read_text())) if t.endswith(suffix)}


def archive_unreferenced(folder: str, pattern: str, keep: set[str], archive: str, *, dry_run: bool = True) -> list[str]:
    """Moves files that nothing mentions into an archive; with ``dry_run`` only names them."""
    gone = [p for p in sorted(Path(folder).glob(pattern)) if p.name not in keep]
    if not dry_run:
        Path(archive).mkdir(parents=True, exist_ok=True)
        for p in gone:
            p.rename(_free(Path(archive) / p.name))
    return [p.name for p in gone]
