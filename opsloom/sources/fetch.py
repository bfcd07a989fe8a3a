"""Resources of a data set brought to a cache on the driver, with checks and a lock file."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import shutil
import urllib.request
from datetime import UTC, datetime
from pathlib import Path

LIMIT = 5 * 10**9


class FetchError(Exception):
    pass


def parse_size(text: str | int) -> int:
    """Bytes of 5GB, 2 GiB or a plain number."""
    m = re.fullmatch(r"([\d.]+)\s*([kmgt]?)(i?)b?", str(text).strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * (1024 if m[3] else 1000) ** " kmgt".index(m[2] or " "))


def digest(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def chosen(source: dict, name: str | None = None, everything: bool = False) -> list[dict]:
    """The resources of a named slice, of the default one, or all."""
    resources, slices = source["resources"], source.get("slices")
    if not slices or everything:
        if name and not slices:
            raise FetchError("this data set has no slices")
        return resources
    name = name or slices.get("default")
    if name not in slices.get("available", {}):
        raise FetchError(f"unknown slice {name!r}")
    found = [r for r in resources if any(fnmatch.fnmatch(r["filename"], g) for g in slices["available"][name]["include"])]
    if not found:
        raise FetchError(f"slice {name!r} has no resources")
    return found


def _bring(resource: dict, to: Path, manual: Path | None) -> None:
    part = to.with_suffix(to.suffix + ".part")
    if manual is not None:
        if not (manual / resource["filename"]).exists():
            raise FetchError(f"put {resource['filename']} into {manual}")
        shutil.copy(manual / resource["filename"], part)
    else:
        with urllib.request.urlopen(resource["url"]) as answer, part.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(answer, out)
    with part.open("rb") as f:
        if to.suffix not in (".html", ".htm") and f.read(512).lstrip().lower().startswith((b"<!doctype html", b"<html")):
            part.unlink()
            raise FetchError(f"{resource['filename']}: a web page came instead of the file")
    os.replace(part, to)


def fetch(dataset: str, source: dict, cache: str, *, name: str | None = None, everything: bool = False, limit: int = LIMIT, large: bool = False, offline: bool = False, manual: str | None = None) -> list[Path]:
    """Files of a slice below cache/<dataset>/raw; those there with the right hash are kept."""
    resources = chosen(source, name, everything)
    if not large and sum(int(r.get("bytes", 0)) for r in resources) >= limit:
        raise FetchError("the selection is too large; allow it with large=True")
    root = Path(cache) / dataset / "raw"
    root.mkdir(parents=True, exist_ok=True)
    out, locked = [], []
    if manual:  # files by hand may be named by a pattern
        resources = [r | {"filename": f.name} for r in resources for f in (sorted(Path(manual).glob(r["filename"])) if "*" in r["filename"] else [Path(r["filename"])])]
        if not resources:
            raise FetchError(f"no file in {manual} has a wanted name")
    for r in resources:
        path = root / r["filename"]
        if not (path.exists() and r.get("sha256") in (None, digest(path))):
            if offline:
                raise FetchError(f"{r['filename']} is not in the cache")
            _bring(r, path, Path(manual) if manual else None)
            if r.get("sha256") not in (None, digest(path)):
                path.unlink()
                raise FetchError(f"{r['filename']}: wrong hash")
        out.append(path)
        locked.append({"filename": r["filename"], "sha256": digest(path), "bytes": path.stat().st_size})
    lock = {"dataset": dataset, "slice": name, "fetched_at": datetime.now(UTC).isoformat(), "resources": locked}
    (root.parent / f"{dataset}.lock.json").write_text(json.dumps(lock, indent=2, sort_keys=True), encoding="utf-8")
    return out
