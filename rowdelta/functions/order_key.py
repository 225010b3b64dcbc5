"""An order-preserving value of fixed width, so that the greatest row of a group is found by a hash aggregate.

Spark keeps an aggregate's buffer in place, and so hashes, only for values of fixed width: the maximum of a struct, a text
or bytes is a sort before and after the shuffle. One column of fixed width is an order by itself. Several are packed into
a long, each as an unsigned number beside the one before it, where their widths fit. (Packing wider ones into a decimal
of 38 digits hashes too, but was measured at half the speed of the sort.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a long holds without sign.
BITS = 63
_WIDTHS = {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.DateType: 32}


def fixed(kind: T.DataType) -> bool:
    """Whether an aggregate can keep a value of the type in place."""
    return isinstance(kind, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType)


def width(kind: T.DataType) -> int | None:
    """Bits that a type takes in a packed key, one of them for null; None for a type that is not packed."""
    if isinstance(kind, T.DecimalType):
        return (2 * 10**kind.precision).bit_length() + 1 if kind.precision < 18 else None
    bits = _WIDTHS.get(type(kind))
    return bits and bits + 1


def _unsigned(c: Column, kind: T.DataType) -> Column:
    """From 1 up in the type's order; null is 0."""
    if isinstance(kind, T.BooleanType):
        number, least = c.cast("int"), 0
    elif isinstance(kind, T.DateType):
        number, least = F.unix_date(c), -(1 << 31)
    elif isinstance(kind, T.DecimalType):
        number, least = c * F.lit(10**kind.scale), -(10**kind.precision)
    else:
        number, least = c, -(1 << (_WIDTHS[type(kind)] - 1))
    return F.coalesce(number.cast("long") + F.lit(1 - least), F.lit(0)).cast("long")


def order_key(columns: Sequence[Column], kinds: Sequence[T.DataType]) -> Column | None:
    """A value of fixed width whose order is that of the tuple, nulls least; None where the columns do not fit.

    That of a single column is the column itself, and null where it is null; others are never null."""
    if len(columns) == 1 and fixed(kinds[0]):
        return columns[0]
    widths = [width(k) for k in kinds]
    if not columns or None in widths or sum(widths) > BITS:
        return None
    key = F.lit(0).cast("long")
    for c, kind, bits in zip(columns, kinds, widths, strict=True):
        key = F.shiftleft(key, bits) + _unsigned(c, kind)
    return key
