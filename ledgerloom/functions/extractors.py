"""The registry of answer extractors: scalar functions from a text column to a canonical value, with tags that change with their source."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import Column

from ledgerloom.functions import answers, lenient

Extractor = Callable[[Column], Column]
_REGISTRY: dict[str, tuple[Extractor, tuple[object, ...]]] = {
    "v1": (answers.extract_strict, (answers,)),
    "v2": (lambda text: lenient.extract_lenient(text)["value"], (lenient,)),
}


def register(name: str, extractor: Extractor, *sources: object) -> None:
    """Adds an extractor; ``sources`` are the modules or functions that its tag hashes, by default itself."""
    if name in _REGISTRY:
        raise ValueError(f"extractor {name!r} is registered already")
    _REGISTRY[name] = (extractor, sources or (extractor,))


def names() -> list[str]:
    return sorted(_REGISTRY)


def extract(name: str, text: Column) -> Column:
    if name not in _REGISTRY:
        raise KeyError(f"unknown extractor {name!r}; registered: {names()}")
    return _REGISTRY[name][0](text)


def source_hash(name: str) -> str:
    """Twelve hex digits over the sources of an extractor, whatever their line endings."""
    h = hashlib.sha256()
    for source in _REGISTRY[name][1]:
        h.update("\n".join(inspect.getsource(source).splitlines()).encode())
    return h.hexdigest()[:12]


def tag(name: str) -> str:
    return f"{name}@{source_hash(name)[:8]}"


def changed(pinned: Mapping[str, str]) -> dict[str, tuple[str | None, str | None]]:
    """{name: (pinned, now)} of the extractors that aren't as pinned; a missing side is None."""
    now = {name: source_hash(name) for name in _REGISTRY}
    return {name: (pinned.get(name), now.get(name)) for name in sorted({*pinned, *now}) if pinned.get(name) != now.get(name)}
