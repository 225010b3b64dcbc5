"""What is resolved on the driver before a plan exists: types, keys, compared columns."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import types as T


def first_fields(schema: T.StructType) -> dict[str, tuple[int, T.DataType]]:
    """Name to place and type; names are case-sensitive and the first of equals counts."""
    out: dict[str, tuple[int, T.DataType]] = {}
    for i, f in enumerate(schema.fields):
        out.setdefault(f.name, (i, f.dataType))
    return out


def check_types(source: T.StructType, target: T.StructType, ignore: Iterable[str] = ()) -> None:
    """Columns of both sides that are not ignored must have one type; nullability does not matter."""
    a, b, ignore = first_fields(source), first_fields(target), set(ignore)
    for name, (_, kind) in a.items():
        if name in b and name not in ignore and kind.simpleString() != b[name][1].simpleString():
            raise TypeError(f"incompatible types for column {name}: {kind.simpleString()} and {b[name][1].simpleString()}")


def resolve_keys(keys: Iterable[str], primary_key: str | None, source: list[str], ignore: Iterable[str] = ()) -> list[str]:
    """Explicit keys, else the source's primary key (one name), else all source columns that are not ignored."""
    if keys := list(keys):
        return keys
    if primary_key:
        return [primary_key]
    ignore = set(ignore)
    warnings.warn("no key columns: all columns that are not ignored are the key, so no row can be modified", stacklevel=3)
    if out := [c for c in dict.fromkeys(source) if c not in ignore]:
        return out
    raise ValueError("no key columns specified")


def compare_columns(source: list[str], keys: Iterable[str], ignore: Iterable[str]) -> list[str]:
    """Source columns that are neither keys nor ignored."""
    out = set(keys) | set(ignore)
    return [c for c in dict.fromkeys(source) if c not in out]
