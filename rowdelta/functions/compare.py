"""Equality of values and keys as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Equality within a tolerance: absolute if either is zero, else relative to the larger magnitude.

    NaN equals NaN and an infinity only itself; being exactly ``tolerance`` apart is not equal."""
    a, b, tol = a.cast("double"), b.cast("double"), F.lit(float(tolerance))
    off = F.abs(a - b)
    within = F.when((a == 0) | (b == 0), off < tol).otherwise(off / F.greatest(F.abs(a), F.abs(b)) < tol)
    # an infinite difference over an infinite magnitude is NaN, which Spark orders last: never within
    return (a == b) | within


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def comparable(c: Column, kind: T.DataType) -> Column:
    """Maps have no equality or order in SQL; their entries in key order do, at any depth."""
    if not has_map(kind):
        return c
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: comparable(x, kind.elementType))
    fields = [comparable(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
    return F.when(c.isNotNull(), F.struct(*fields))


def differs(a: Column, b: Column, kind: T.DataType, tolerance: float = 0.0) -> Column:
    """Never null: whether two values of one type differ. Null equals only null."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).otherwise(~float_equal(a, b, tolerance))
    return ~comparable(a, kind).eqNullSafe(comparable(b, kind))


def _default(kind: T.DataType) -> Column | None:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    return None


def typed_key(key: Column, kind: T.DataType) -> list[Column]:
    """Plain columns whose equality is null-safe equality of the key.

    A join and a window on such columns share one exchange, which null-safe operators would not."""
    if has_map(kind):
        raise ValueError("a map cannot be a key")
    default = _default(kind)
    if default is None:  # nested: a one-element array is never null itself
        return [F.array(key)]
    return [F.coalesce(key, default), key.isNull()]


def text_key(keys: Sequence[Column]) -> Column:
    """Key values as text, joined by pipes; null is the text NULL."""
    return F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("NULL")) for k in keys])
