"""Options, results and schema descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class DiffOptions:
    """How two datasets are compared.

    ``tolerance`` is for float columns; 0 is exact. ``order_by`` says which of several rows of a key wins: the
    greatest, of equal ones that by the other columns. ``unique_keys`` promises that there are no such rows. ``key_style`` is "typed", where null keys
    equal only null keys, or "text", where key values are joined as text by pipes and null is ``NULL``.
    ``checksums`` compares sums of row hashes by buckets of keys first, by which equal buckets are left out: a job or two
    before the comparison, worth it where little changed. A key of over ``hot_rows`` rows and a hundredth of its side
    is spread over tasks by ``changes``.
    ``batch_size``, ``parallel`` and ``workers`` are accepted for compatibility: Spark plans its own tasks.
    """

    keys: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    tolerance: float = 0.0
    order_by: tuple[str, ...] = ()
    unique_keys: bool = False
    key_style: str = "typed"
    target_values: bool = False
    validate: str | None = None
    checksums: bool = False
    hot_rows: int = 100_000
    batch_size: int = 10_000
    parallel: bool = False
    workers: int = 0


@dataclass(frozen=True)
class DiffSummary:
    total_source: int
    total_target: int
    added: int
    deleted: int
    modified: int
    #: modified rows by column; columns without any are absent
    columns: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class FieldInfo:
    name: str
    type: pa.DataType
    nullable: bool = True


@dataclass(frozen=True)
class SchemaInfo:
    """A schema with what Spark's own loses: declared nullability, units, zones, encodings and metadata."""

    fields: tuple[FieldInfo, ...]
    metadata: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(schema: pa.Schema) -> SchemaInfo:
        hidden = (b"ARROW:schema", b"pandas")
        meta = {k.decode(): v.decode("utf-8", "replace") for k, v in (schema.metadata or {}).items() if k not in hidden and not k.startswith(b"org.apache.spark")}
        return SchemaInfo(tuple(FieldInfo(f.name, f.type, f.nullable) for f in schema), meta)

    @property
    def by_name(self) -> dict[str, FieldInfo]:
        return {f.name: f for f in reversed(self.fields)}

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass
class Dataset:
    """A readable table: its rows, and its schema as the source declares it."""

    df: DataFrame
    schema: SchemaInfo
    #: columns, in order, that give rows their place in the source; the greatest is the last row
    position: tuple[str, ...] = ()

    def close(self) -> None:
        self.df.unpersist()


@dataclass
class DiffResult:
    """Added, deleted and modified rows as DataFrames; nothing runs before they are used.

    Columns of the modified rows' flags and ``_change_type`` carry ``metadata``, which Parquet and Arrow files keep."""

    added: DataFrame
    deleted: DataFrame
    modified: DataFrame
    summary_frame: DataFrame
    column_counts: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)

    #: what a differ's ``cancel`` ends
    tag: str | None = None

    #: makes what ``changes`` returns, where one pass over both sides gives all of it
    one_pass: Callable[[], DataFrame] | None = None
    #: what the checksums found, level by level
    checksum_levels: tuple = ()

    @contextmanager
    def running(self) -> Iterator[DiffResult]:
        """Jobs of this thread inside can be cancelled by the differ; those outside cannot."""
        spark = self.summary_frame.sparkSession
        if self.tag:
            spark.addTag(self.tag)
        try:
            yield self
        finally:
            if self.tag:
                spark.removeTag(self.tag)

    def summary(self) -> DiffSummary:
        """Runs one job: the counts by column come with the totals."""
        with self.running():
            row = self.summary_frame.first()
        counts = {k: v for k, v in (row["columns"] or {}).items() if v}
        return DiffSummary(*(row[k] for k in ("total_source", "total_target", "added", "deleted", "modified")), counts)

    def changes(self) -> DataFrame:
        """All three in one frame with ``_change_type``; columns a part lacks are null.

        Each side is read and shuffled once, but for hot keys and odd names."""
        if self.one_pass is not None:
            with self.running():
                return self.one_pass()
        from pyspark.sql import functions as F

        tagged = [df.select(F.lit(kind).alias("_change_type", metadata=self.metadata), *[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]) for kind, df in (("added", self.added), ("deleted", self.deleted), ("modified", self.modified))]
        return tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)


@runtime_checkable
class Differ(Protocol):
    def diff(self, source: DataFrame, target: DataFrame, options: DiffOptions) -> DiffResult: ...


@runtime_checkable
class Reporter(Protocol):
    def report(self, result: DiffResult) -> None: ...
