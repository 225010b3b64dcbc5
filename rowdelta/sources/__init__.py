"""Readers by type name, and the types of file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowdelta.model import Dataset

from .arrow_file import read_arrow
from .files import read_csv, read_jdbc, read_parquet
from .sqlite import read_sqlite, write_sqlite

Reader = Callable[..., Dataset]
READERS: dict[str, Reader] = {"parquet": read_parquet, "arrow": read_arrow, "csv": read_csv, "jdbc": read_jdbc, "sqlite": read_sqlite}
SUFFIXES = {".parquet": "parquet", ".arrow": "arrow", ".csv": "csv", ".db": "duckdb", ".duckdb": "duckdb"}


def register(kind: str, reader: Reader) -> None:
    READERS[kind] = reader


def detect_type(path: str, strict: bool = False) -> str:
    """The type by suffix. An unknown suffix is Parquet, or an error if ``strict``; databases have no reader."""
    name = path.rstrip("/").lower()
    for suffix, kind in SUFFIXES.items():
        if name.endswith(suffix) and not (strict and kind == "duckdb"):
            return kind
    if strict:
        raise ValueError(f"cannot tell the type of {path}")
    return "parquet"


def read(spark: SparkSession, path: str, kind: str = "auto", **options) -> Dataset:
    kind = detect_type(path) if kind in ("auto", "") else kind
    if not path:
        raise ValueError("a path is required")
    if kind not in READERS:
        raise ValueError(f"unsupported reader type: {kind}")
    return READERS[kind](spark, path, **options)


def full_load(data: Dataset) -> Dataset:
    """Keep the rows once read, spilling to disk; ``close`` lets them go."""
    return Dataset(data.df.persist(), data.schema, data.position)


def concat(*parts: DataFrame) -> DataFrame:
    """Batches of one table on end."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same schema."""
    return df.sparkSession.createDataFrame([], df.schema)
