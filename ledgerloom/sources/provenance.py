"""Where a result comes from: a record of versions and settings, and its digest."""

from __future__ import annotations

import copy
import hashlib
import json
import platform
import subprocess
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import SparkSession

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")
#: What differs between runs that are the same otherwise.
VOLATILE = (("created_at",), ("git", "dirty"), ("spark", "application"))


def canonical_digest(value: object, digits: int = 16) -> str:
    """Hex digits of SHA-256 over compact JSON with sorted keys."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:digits]


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def _version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def record(spark: SparkSession, config: dict, extra: dict | None = None) -> dict:
    """A JSON-ready record of a run."""
    from ledgerloom.functions.extractors import names, tag

    status = _git("status", "--porcelain")
    return {
        "created_at": datetime.now(timezone.utc).isoformat(timespec="milliseconds"),
        "git": {"commit": _git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)},
        "packages": {p: _version(p) for p in PACKAGES},
        "python": platform.python_version(),
        "spark": {"version": spark.version, "master": spark.sparkContext.master, "application": spark.sparkContext.applicationId},
        "extractors": {name: tag(name) for name in names()},
        "config": config,
        "config_hash": canonical_digest(config),
        **(extra or {}),
    }


def digest(provenance: dict) -> str:
    """The digest of a record without its volatile fields."""
    kept = copy.deepcopy(provenance)
    for *path, last in VOLATILE:
        node = kept
        for key in path:
            node = node.get(key, {}) if isinstance(node, dict) else {}
        if isinstance(node, dict):
            node.pop(last, None)
    return canonical_digest(kept)
