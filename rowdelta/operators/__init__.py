"""Sides, keys and checksums of a comparison."""

from .checksums import Level, Narrowed, narrow
from .keys import check_types, compare_columns, first_fields, resolve_keys
from .side import Side

__all__ = ["Level", "Narrowed", "Side", "check_types", "compare_columns", "first_fields", "narrow", "resolve_keys"]
