"""One side of a comparison with its rows keyed, renamed by place and reduced to one row a key."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.functions.compare import comparable, text_key, typed_key
from rowdelta.functions.order_key import order_key
from rowdelta.operators.keys import first_fields


class Side:
    """Columns are ``{tag}{place}``, so that dots, case and repeated names cannot clash; keys are ``k{n}``.

    Of rows that ``order_by`` leaves equal the greatest by ``ties`` is last, then that by the side's other columns. With the
    compared columns of both sides as ``ties``, in one sequence, both sides choose alike."""

    def __init__(self, df: DataFrame, tag: str, keys: list[str], key_style: str, order_by: tuple[str, ...], unique: bool, ties: tuple[str, ...] | None = None):
        self.names, self.tag, self.unique = df.columns, tag, unique
        self.fields = first_fields(df.schema)
        for k in (*keys, *order_by):
            if k not in self.fields:
                raise ValueError(f"key column not found: {k}" if k in keys else f"order column not found: {k}")
        renamed = df.toDF(*[f"{tag}{i}" for i in range(len(df.columns))])
        if key_style == "text":
            made = [text_key([self.column(k) for k in keys])]
        elif key_style == "typed":
            made = [c for k in keys for c in typed_key(self.column(k), self.fields[k][1])]
        else:
            raise ValueError(f"unknown key style: {key_style}")
        self.on = [f"k{i}" for i in range(len(made))]
        # computed below any window or join, so that both use the same hash partitioning
        self.rows = renamed.select("*", *[c.alias(n) for c, n in zip(made, self.on, strict=True)])
        #: the columns that say what is compared of a key's last row
        self.deciding = () if unique else tuple(dict.fromkeys((*order_by, *(ties or ())))) if order_by else tuple(self.fields)
        rest = [n for n in self.fields if (n not in keys or key_style == "text") and _sortable(self.fields[n][1])] if ties is not None else []
        #: the columns that say which row of a key is last
        self.ordered = () if unique else tuple(dict.fromkeys((*self.deciding, *rest)))
        self.by = [self._by(n) for n in self.deciding]
        self.order = [self._by(n).desc_nulls_last() for n in self.ordered]
        #: what decides as one value of fixed width, where it fits, and whether the order alone would
        self.packed = self._packed(self.deciding)
        self.short = self.packed is not None or self._packed(order_by) is not None

    def _by(self, name: str) -> Column:
        return comparable(self.column(name), self.fields[name][1])

    def _packed(self, names: tuple[str, ...]) -> Column | None:
        return order_key([self._by(n) for n in names], [self.fields[n][1] for n in names])

    def where(self, condition: Column) -> Side:
        """The side with some of its rows."""
        out = copy.copy(self)
        out.rows = self.rows.where(condition)
        return out

    def column(self, name: str) -> Column:
        return F.col(f"{self.tag}{self.fields[name][0]}")

    def originals(self, df: DataFrame) -> DataFrame:
        """The side's own columns under their own names."""
        return df.select(*[f"{self.tag}{i}" for i in range(len(self.names))]).toDF(*self.names)

    def last(self) -> DataFrame:
        """One row a key, the last of several. Ranks are limited before the shuffle, so a hot key is one row there."""
        if self.unique:
            return self.rows
        return self._first(self.order)

    def _first(self, order: list[Column]) -> DataFrame:
        ranked = self.rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*self.on).orderBy(*order)))
        return ranked.where("_rank = 1").drop("_rank")

    def counted(self, names: list[str]) -> DataFrame:
        """The columns ``names`` of the last row of each key with ``n_{tag}``, the number of the key's rows.

        The rows of a hot key are counted, and its last one is found, before the shuffle. Where all that decides is packed,
        an aggregate hashes. A short order whose ties other columns break is ranked, and others are sorted as structs."""
        if self.unique:
            return self.rows.withColumn(f"n_{self.tag}", F.lit(1).cast("long"))
        n = F.count(F.lit(1)).alias(f"n_{self.tag}")
        if not names:
            return self.rows.groupBy(*self.on).agg(n)
        if self.packed is not None:
            own = [f"{self.tag}{self.fields[name][0]}" for name in names]
            rows = self.rows.select(*self.on, self.packed.alias("_order"), *own).withColumn("_none", F.when(F.col("_order").isNull(), 0))
            # max_by passes over rows whose order is null: these count where a key has no others
            known = F.max("_order").isNotNull()
            return rows.groupBy(*self.on).agg(n, *[F.when(known, F.max_by(c, "_order")).otherwise(F.max_by(c, "_none")).alias(c) for c in own])
        own = [self.column(c) for c in names]
        if self.short:
            last = self._first([c.desc_nulls_last() for c in self.by]).select(*self.on, *own)
            return last.join(self.rows.groupBy(*self.on).agg(n), self.on)
        last = self.rows.groupBy(*self.on).agg(n, F.max_by(F.struct(*own), F.struct(*self.by)).alias("_last"))
        return last.select(*self.on, f"n_{self.tag}", "_last.*")

    def keys(self) -> DataFrame:
        return self.rows.select(*self.on) if self.unique else self.rows.select(*self.on).distinct()


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _sortable(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.VariantType | T.CalendarIntervalType)


def digest(columns: list[Column], kinds: list[T.DataType]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a tuple. Spark's hash passes nulls over, so where they stand is hashed beside the values;
    nested values are hashed as JSON, which tells a null from its place too."""
    plain = [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if isinstance(k, T.ArrayType | T.StructType | T.MapType | T.VariantType) else c for c, k in zip(columns, kinds, strict=True)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(1), nulls, *plain), F.xxhash64(F.lit(2), *plain, nulls)
