"""A tree of checksums that finds where two sides can differ without moving their rows.

Rows fall into buckets by their key. A bucket's checksum is its number of rows and sums of two hashes of each row, so it
does not depend on the order of rows. Buckets with equal checksums on both sides hold the same rows: nothing in them was
added, deleted or modified under any tolerance, as equal values are equal under each. Those that differ are divided
further while that can leave out rows. Sums combine before their shuffle, so a level moves a row a bucket and task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.functions.compare import comparable

from .side import Side, digest

#: Buckets of the first level, by how many each is divided further, and the most there are: what the driver holds of
#: a level and what is sent to all tasks is bounded by them.
FIRST, FURTHER, MOST = 1 << 12, 1 << 4, 1 << 20
#: Buckets that a condition names; more are a broadcast table.
FEW = 64
#: A bucket of fewer rows is not divided, and none is where the rows left are so small a share of all: another level would
#: cost a scan and save little.
SMALL, ENOUGH = 64, 0.05
#: Bits of hashes that are summed: no sum overflows under 2**39 rows of a bucket.
_SLICES = ((0, 24), (24, 20), (44, 20))


@dataclass(frozen=True)
class Level:
    buckets: int
    #: buckets that differ, and the rows of both sides in them
    differing: int
    source_rows: int
    target_rows: int


@dataclass
class Narrowed:
    """Both sides' rows of differing buckets, and how many rows of each side are in the others."""

    source: DataFrame
    target: DataFrame
    skipped: int
    levels: list[Level] = field(default_factory=list)


def _row_hashes(side: Side, compared: list[str]) -> tuple[Column, Column]:
    names = list(dict.fromkeys((*side.deciding, *compared)))
    columns = [comparable(side.column(n), side.fields[n][1]) for n in names]
    return digest([F.col(k) for k in side.on] + columns, [side.rows.schema[k].dataType for k in side.on] + [side.fields[n][1] for n in names])


def narrow(s: Side, t: Side, compared: list[str], first: int = FIRST, small: int = SMALL, enough: float = ENOUGH) -> Narrowed | None:
    """The rows of ``s`` and ``t`` that checksums cannot rule out; runs a job a level, and each reads both sides again.

    None where checksums say nothing: a compared column that the target lacks is modified in every row, and rows of a
    key have an order that is not of the same columns on both sides."""
    if any(c not in t.fields for c in compared) or set(s.deciding) != set(t.deciding):
        return None
    if any(s.fields[n][1].simpleString() != t.fields[n][1].simpleString() for n in s.deciding):
        return None
    frames = []
    for side in (s, t):
        h, g = _row_hashes(side, compared)
        parts = [F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1)) for x in (h, g) for at, bits in _SLICES]
        frames.append(side.rows.select(F.xxhash64(*side.on).alias("at"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]))
    buckets, bad, levels, total, every = first, None, [], 0, 0
    while True:
        sums = []
        for df, tag in zip(frames, "st", strict=True):
            own = df if bad is None else _inside(df, F.pmod("at", F.lit(levels[-1].buckets)), bad)
            parts = F.array(*[F.sum(f"p{i}") for i in range(2 * len(_SLICES))])
            sums.append(own.groupBy(F.pmod("at", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias(f"n_{tag}"), parts.alias(f"sums_{tag}")))
        both = sums[0].join(sums[1], "bucket", "full_outer")
        same = F.col("n_s").eqNullSafe(F.col("n_t")) & F.col("sums_s").eqNullSafe(F.col("sums_t"))
        # equal buckets are one row together
        one = both.groupBy(F.when(~same, F.col("bucket")).alias("bucket")).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_s", "n_t")])
        found = one.toPandas()
        if not levels:
            total, every = int(found["n_s"].sum()), int(found["n_s"].sum() + found["n_t"].sum())
        found = found[found["bucket"].notna()]
        bad = found["bucket"].astype("int64").tolist()
        levels.append(Level(buckets, len(bad), int(found["n_s"].sum()), int(found["n_t"].sum())))
        rows = levels[-1].source_rows + levels[-1].target_rows
        if rows <= enough * every or buckets * FURTHER > MOST or rows < small * len(bad):
            break
        buckets *= FURTHER
    inside = [_inside(side.rows, F.pmod(F.xxhash64(*side.on), F.lit(buckets)), bad) for side in (s, t)]
    return Narrowed(*inside, total - levels[-1].source_rows, levels)


def _inside(df: DataFrame, bucket: Column, chosen: list[int]) -> DataFrame:
    """Rows whose bucket is among ``chosen``, of which there are at most ``MOST``."""
    if len(chosen) <= FEW:
        return df.where(bucket.isin(chosen))
    one = df.sparkSession.createDataFrame(pa.table({"_chosen": pa.array(chosen, pa.int64())}))
    return df.join(F.broadcast(one), bucket == F.col("_chosen"), "left_semi")
