"""Settings: lines of a key and a value, overlaid by --key value arguments, held against a dataclass."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Iterable
from typing import TypeVar

T = TypeVar("T")
_YES, _NO = {"true", "1", "yes"}, {"false", "0", "no"}


def parse(lines: Iterable[str]) -> dict[str, str]:
    """key -> value of each line; what follows the value is ignored, as are blank lines and those after #. The last one wins."""
    words = (line.split() for line in lines)
    return {w[0]: w[1] if len(w) > 1 else "" for w in words if w and not w[0].startswith("#")}


def overlay(found: dict[str, str], arguments: list[str]) -> dict[str, str]:
    """found with `--key value` arguments over it; a key without a value is true."""
    out, i = dict(found), 0
    while i < len(arguments):
        if not arguments[i].startswith("--") or len(arguments[i]) == 2:
            raise ValueError(f"expected --key, not {arguments[i]}")
        has = i + 1 < len(arguments) and not arguments[i + 1].startswith("--")
        out[arguments[i][2:]] = arguments[i + 1] if has else "true"
        i += 2 if has else 1
    return out


def _typed(name: str, kind: type, value: str):
    try:
        if kind is bool:
            if value.lower() not in _YES | _NO:
                raise ValueError(value)
            return value.lower() in _YES
        return kind(value)
    except ValueError as wrong:
        raise ValueError(f"{name}: {value!r} is no {kind.__name__}") from wrong


def settings(kind: type[T], found: dict[str, str]) -> T:
    """An instance of a dataclass; a field without a default is mandatory, keys it doesn't have are ignored."""
    types = typing.get_type_hints(kind)
    missing = [f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.name not in found]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return kind(**{f.name: _typed(f.name, types[f.name], found[f.name]) for f in dataclasses.fields(kind) if f.name in found})
