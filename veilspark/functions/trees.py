"""Walks over JSON values of any shape, for Python workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


def map_strings(value: Any, change: Callable[[str], str]) -> Any:
    """The same tree with each string value changed; keys and other values stay."""
    if isinstance(value, str):
        return change(value)
    if isinstance(value, dict):
        return {k: map_strings(v, change) for k, v in value.items()}
    return [map_strings(v, change) for v in value] if isinstance(value, list) else value


def strings(value: Any) -> list[str]:
    """All string values, depth first."""
    out: list[str] = []
    map_strings(value, lambda s: (out.append(s), s)[1])
    return out


def flatten(value: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted keys; of a list of plain values the first; lists of lists or objects, and empty ones, are left out."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict):
            out |= flatten(v, key)
        elif not isinstance(v, list):
            out[key] = v
        elif v and not isinstance(v[0], dict | list):
            out[key] = v[0]
    return out
