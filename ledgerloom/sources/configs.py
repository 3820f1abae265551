"""Configuration files: YAML with inheritance and dotted overrides.  Driver side, a few kilobytes."""

from __future__ import annotations

from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that can't be resolved."""


def merge(base: dict, over: dict) -> dict:
    """Mappings merge key by key; anything else in ``over`` replaces."""
    out = dict(base)
    for key, value in over.items():
        old = out.get(key)
        out[key] = merge(old, value) if isinstance(old, dict) and isinstance(value, dict) else value
    return out


def override(config: dict, path: str, value: Any) -> dict:
    """``config`` with the value at a dotted path replaced."""
    head, _, rest = path.partition(".")
    inner = override(config.get(head, {}), rest, value) if rest else value
    return {**config, head: inner}


def load(path: str | Path, overrides: dict[str, Any] | None = None) -> dict:
    """The file's mapping over those it ``extends``, with dotted overrides on top.  Raises ConfigError on a cycle."""
    import yaml

    chain: list[dict] = []
    seen: set[Path] = set()
    at: Path | None = Path(path).resolve()
    while at is not None:
        if at in seen:
            raise ConfigError(f"{at} extends itself")
        seen.add(at)
        own = yaml.safe_load(at.read_text()) or {}
        if not isinstance(own, dict):
            raise ConfigError(f"{at} is no mapping")
        parent = own.pop("extends", None)
        chain.append(own)
        at = (at.parent / parent).resolve() if parent else None
    out: dict = {}
    for part in reversed(chain):
        out = merge(out, part)
    for dotted, value in (overrides or {}).items():
        out = override(out, dotted, value)
    return out
