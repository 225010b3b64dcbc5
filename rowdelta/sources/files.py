"""Parquet, CSV and JDBC sources on Spark's own readers."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.model import Dataset, SchemaInfo
from rowdelta.schema.types import schema_of, spark_type

from .footers import footers, merged_schema, read_footer
from .hadoop import data_files

FILE, ROW = "_file_path", "_row_index"


def local_files(path: str, suffix: str) -> list[str]:
    """Data files of a path this machine can open, in name order; none if it cannot."""
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        return []
    found = [os.path.join(top, n) for top, _, names in os.walk(path) for n in names if n.endswith(suffix) and n[0] not in "._"]
    return sorted(found)


def read_parquet(spark: SparkSession, path: str, positions: bool = False) -> Dataset:
    """Declared schema facts come from the footers of all files, see :func:`merged_schema`, on any file system.

    Files that lack columns of others give nulls for them. With ``positions`` the rows carry their file and place as
    hidden order columns."""
    files = [f for f, size in data_files(spark, path) if size > 0]
    info = None
    if len(files) == 1:
        info = SchemaInfo.of(read_footer(spark, files[0]).schema.to_arrow_schema())
    elif files:
        info = merged_schema(footers(spark, path))
    reader = spark.read
    if info:
        for f in info.fields:
            _readable(f.name, f.type)
        if len(files) > 1 and not set(info.names) <= set(reader.parquet(path).columns):
            reader = reader.option("mergeSchema", True)
    df = reader.parquet(path)
    if positions:
        df = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        return Dataset(df, info or schema_of(df), (FILE, ROW))
    return Dataset(df, info or schema_of(df))


def _readable(name: str, kind: pa.DataType) -> None:
    odd = pa.types.is_time(kind) or pa.types.is_float16(kind) or pa.types.is_decimal256(kind) or (pa.types.is_timestamp(kind) and kind.unit == "ns")
    if odd:
        raise TypeError(f"unsupported type of column {name}: {kind}")
    if not pa.types.is_null(kind):
        spark_type(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Dataset:
    """A header and inferred types; only empty fields are null. Inferred integers are 64-bit.

    Give ``schema`` to skip the inferring pass over the file."""
    plain = spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False)
    if schema is None:
        seen = plain.option("inferSchema", True).csv(path).schema
        schema = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in seen.fields])
    df = plain.schema(schema).csv(path)
    return Dataset(df, schema_of(df))


def read_jdbc(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, ranges: tuple[str, object, object, int] | None = None, even: tuple[str, int] | None = None, **options) -> Dataset:
    """A table or query of the database at the JDBC address ``path``.

    With ``ranges`` (column, low, high, n) a table is read by n tasks, each an equal range of the column's values; with
    ``even`` (column, n) by about n tasks of about as many rows each, see :func:`quantile_predicates`; without, by one."""
    reader = spark.read.format("jdbc").option("url", path).options(**options)
    if even and (query or ranges):
        raise ValueError("even parts are of a table, and need no ranges")
    if even:
        predicates = quantile_predicates(spark, path, table, *even, **options)
        df = spark.read.jdbc(path, table, predicates=predicates, properties={k: str(v) for k, v in options.items()})
        return Dataset(df, schema_of(df))
    if ranges:
        if query:
            raise ValueError("ranges are of a table")
        reader = reader.options(**dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, ranges), strict=True)))
    df = (reader.option("query", query) if query else reader.option("dbtable", table)).load()
    return Dataset(df, schema_of(df))


def quantile_predicates(spark: SparkSession, path: str, table: str, column: str, n: int, **options) -> list[str]:
    """Conditions that divide a table's rows into at most n parts of about as many rows, whatever the column's values.

    The database itself is asked for the values at every n-th of the column's order, so that a run of close values does
    not fall to one task as it would by equal ranges. A value that very many rows share is one part, and rows without a
    value are one. Numbers, texts, dates and times can divide."""
    ask = lambda q: spark.read.format("jdbc").option("url", path).options(**options).option("query", q).load()
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(path).quoteIdentifier(column)
    return even_predicates(lambda q: ask(q).first(), table, column, n, "OFFSET {} ROWS FETCH NEXT 1 ROWS ONLY")


def even_predicates(ask: Callable[[str], Sequence | None], table: str, column: str, n: int, nth: str) -> list[str]:
    """As :func:`quantile_predicates`; ``ask`` gives a query's first row, and ``nth`` is how SQL takes the row at a place."""
    total, known = (int(x) for x in ask(f"SELECT COUNT(*) AS a, COUNT({column}) AS b FROM {table}"))
    bounds = []
    for i in range(1, min(n, known)):
        row = ask(f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL ORDER BY {column} {nth.format(i * known // n)}")
        if row is not None and row[0] not in bounds:
            bounds.append(row[0])
    cuts = [_literal(b) for b in bounds]
    # a part is from its bound up to the next one
    parts = [f"{column} < {cuts[0]}" if cuts else f"{column} IS NOT NULL"]
    parts += [f"{column} >= {a}" + (f" AND {column} < {b}" if b else "") for a, b in zip(cuts, [*cuts[1:], None], strict=False)]
    return parts + ([f"{column} IS NULL"] if known < total else [])


def _literal(value: object) -> str:
    """A value as SQL."""
    if isinstance(value, bool) or value is None:
        raise TypeError("a column of truth values cannot divide a table")
    if isinstance(value, int | float | Decimal):
        return repr(value) if isinstance(value, float) else str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP('{value.isoformat(sep=' ')}')"
    if isinstance(value, date):
        return f"DATE('{value.isoformat()}')"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"a column of {type(value).__name__} cannot divide a table")
