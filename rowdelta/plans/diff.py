"""The comparison of two datasets as one lazy plan per result."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.functions.compare import differs
from rowdelta.model import Dataset, DiffOptions, DiffResult
from rowdelta.operators import Side, check_types, compare_columns, narrow, resolve_keys
from rowdelta.plans.one_pass import split_by_heat
from rowdelta.schema import ValidationLevel, Validator, schema_of

FLAG = "_modified_"


def diff(source: DataFrame | Dataset, target: DataFrame | Dataset, options: DiffOptions = DiffOptions()) -> DiffResult:
    """What was added to, deleted from and modified in ``source`` to make ``target``.

    Added and deleted rows keep their duplicates; of several rows of a key only the last is compared. Modified
    rows have the source's values and a flag ``_modified_<column>`` for each source column: false for keys and
    ignored columns, true throughout for columns that the target lacks. Columns only the target has are never
    compared.
    """
    a, b = (x if isinstance(x, Dataset) else Dataset(x, schema_of(x)) for x in (source, target))
    if options.validate:
        outcome = Validator(level=ValidationLevel(options.validate)).validate_against(a.schema, b.schema)
        if not outcome.valid:
            raise ValueError(f"schemas do not agree: {outcome.errors}")
    check_types(a.df.schema, b.df.schema, options.ignore)
    keys = resolve_keys(options.keys, a.schema.metadata.get("primary_key"), a.df.columns, options.ignore)
    compared = compare_columns(a.df.columns, keys, options.ignore)
    ties = tuple(c for c in compared if c in b.df.columns) if options.order_by else None
    s = Side(a.df, "s", keys, options.key_style, options.order_by or a.position, options.unique_keys, ties)
    t = Side(b.df, "t", keys, options.key_style, options.order_by or b.position, options.unique_keys, ties)

    # without key columns in common types a key's plain columns could differ in number
    if len(s.on) != len(t.on):
        raise TypeError("key columns have other types in the target")
    narrowed = narrow(s, t, compared) if options.checksums else None
    if narrowed:
        s.rows, t.rows = narrowed.source, narrowed.target
    skipped = F.lit(narrowed.skipped if narrowed else 0)
    flags = {c: _flag(s, t, c, options.tolerance) for c in compared}
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f

    added, deleted, pairs = _joined(s, t, any_flag)
    own = [F.col(f"s{i}").alias(n) for i, n in enumerate(s.names)]
    metadata = {"modified_record": "true", "modification_time": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    changed_in = {n: F.coalesce(flags.get(n, F.lit(False)), F.lit(True)) for n in s.names}
    marks = [c.alias(FLAG + n, metadata=metadata) for n, c in changed_in.items()]
    if clash := set(s.names) & {FLAG + n for n in s.names}:
        raise ValueError(f"columns of the source are named like flags: {', '.join(sorted(clash))}")
    extra = [t.column(n).alias(f"_target_{n}") for n in s.names if n in t.fields] if options.target_values else []
    modified = pairs.select(*own, *marks, *extra)
    one_pass_of = _one_pass(s, t, any_flag, changed_in, options, metadata)

    # totals: one full outer join of one row a key; each side's duplicates are counted on the way
    common = [c for c in compared if c in t.fields]
    both = s.counted(common).join(t.counted(common), s.on, "full_outer")
    changed = F.col("n_s").isNotNull() & F.col("n_t").isNotNull() & any_flag
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = F.create_map(*[x for c in compared for x in (F.lit(c), F.count_if(changed & flags[c]))]) if compared else F.create_map().cast("map<string,bigint>")
    summary = both.agg(
        (total(F.col("n_s")) + skipped).alias("total_source"),
        (total(F.col("n_t")) + skipped).alias("total_target"),
        total(F.when(F.col("n_s").isNull(), F.col("n_t"))).alias("added"),
        total(F.when(F.col("n_t").isNull(), F.col("n_s"))).alias("deleted"),
        F.count_if(changed).alias("modified"),
        counts.alias("columns"),
    )
    by_column = summary.select(F.explode("columns").alias("column", "modifications")).where("modifications > 0")
    return DiffResult(added, deleted, modified, summary, by_column, metadata, one_pass=one_pass_of, checksum_levels=tuple(narrowed.levels) if narrowed else ())


def _joined(s: Side, t: Side, any_flag: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Added and deleted rows, and pairs of last rows that differ, each by a join of its own."""
    added = t.originals(t.rows.join(s.keys(), t.on, "left_anti"))
    deleted = s.originals(s.rows.join(t.keys(), s.on, "left_anti"))
    return added, deleted, s.last().join(t.last(), s.on, "inner").where(any_flag)


def _one_pass(s: Side, t: Side, any_flag: Column, changed_in: dict[str, Column], options: DiffOptions, metadata: dict[str, str]) -> Callable[[], DataFrame] | None:
    """What makes the frame of all changes, with each side read and shuffled once.

    Unique keys take a full outer join. Others take :func:`one_pass`, which asks a sketch for hot keys first, so a job
    runs when it is called. None where names that differ in case, repeated names or ignored columns of two types need
    the union's rules."""
    names = list(dict.fromkeys((*t.names, *s.names)))
    plain = len({n.lower() for n in names}) == len(names) and all(len(set(x.names)) == len(x.names) for x in (s, t))
    if not plain or any(s.fields[n][1] != t.fields[n][1] for n in s.names if n in t.fields):
        return None
    here = F.col("kind") != "added"
    is_modified = F.col("kind") == "modified"
    value = lambda n: F.when(here, s.column(n) if n in s.fields else F.lit(None)).otherwise(t.column(n) if n in t.fields else F.lit(None))

    def shape(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("kind").alias("_change_type", metadata=metadata),
            *[value(n).alias(n) for n in names],
            *[F.when(is_modified, c).alias(FLAG + n, metadata=metadata) for n, c in changed_in.items()],
            *[F.when(is_modified, t.column(n)).alias(f"_target_{n}") for n in s.names if options.target_values and n in t.fields],
        )

    def joined(a: Side, b: Side) -> DataFrame:
        added = b.rows.join(a.keys(), b.on, "left_anti").withColumn("kind", F.lit("added"))
        deleted = a.rows.join(b.keys(), a.on, "left_anti").withColumn("kind", F.lit("deleted"))
        pairs = a.last().join(b.last(), a.on, "inner").where(any_flag).withColumn("kind", F.lit("modified"))
        return shape(pairs.unionByName(added, allowMissingColumns=True).unionByName(deleted, allowMissingColumns=True))

    def unique() -> DataFrame:
        in_s, in_t = F.col("in_s").isNotNull(), F.col("in_t").isNotNull()
        kind = F.when(~in_s, "added").when(~in_t, "deleted").when(any_flag, "modified")
        both = s.rows.withColumn("in_s", F.lit(True)).join(t.rows.withColumn("in_t", F.lit(True)), s.on, "full_outer")
        return shape(both.withColumn("kind", kind).where(F.col("kind").isNotNull()))

    return unique if options.unique_keys else lambda: split_by_heat(s, t, shape, any_flag, joined, options.hot_rows)


def _flag(s: Side, t: Side, name: str, tolerance: float) -> Column:
    if name not in t.fields:
        return F.lit(True)
    return differs(s.column(name), t.column(name), s.fields[name][1], tolerance)


class SparkDiffer:
    """The differ of this package. ``cancel`` ends the jobs that run inside ``running()`` of its results, of which
    ``summary()`` is one, from another thread; it has a tag of its own."""

    def __init__(self, tag: str | None = None):
        self.tag = tag or f"rowdelta-{uuid.uuid4().hex}"

    def diff(self, source: DataFrame | Dataset, target: DataFrame | Dataset, options: DiffOptions) -> DiffResult:
        return dataclasses.replace(diff(source, target, options), tag=self.tag)

    def cancel(self, spark) -> None:
        spark.interruptTag(self.tag)

    def close(self) -> None:
        """Nothing is held open."""
