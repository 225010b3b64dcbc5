"""All changes of two sides whose keys repeat, from one shuffle of a tagged union of both.

Rows of a key stand in one order, the source's before the target's, the last row of each side first. What stands first
says whether the source has the key, what stands last whether the target has it; of a key on both sides only the first
row of each side stays, and the source's sees the target's as the next one.

A key with very many rows would be one task's work. A sketch of the keys, which takes no shuffle, finds those that could
be; their rows go through joins that spread them, and only they.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowdelta.functions.compare import comparable
from rowdelta.operators import Side

#: Keys that the sketch of a side may name, items it tracks, and the rows below which no key is hot.
NAMED, TRACKED, FEWEST = 200, 4096, 100_000


def key_hash(side: Side) -> Column:
    return F.xxhash64(*side.on)


def hot_keys(sides: Sequence[Side], fewest: int = FEWEST) -> list[int]:
    """Hashes of keys that may hold over a hundredth of a side's rows and ``fewest`` rows: at most ``NAMED`` a side.

    The sketch counts too many rows for a key at times, by up to about 1 in 3,000 of all, never too few."""
    top = F.expr(f"approx_top_k(h, {NAMED}, {TRACKED})").alias("top")
    each = [x.rows.select(key_hash(x).alias("h")).agg(F.count(F.lit(1)).alias("n"), top) for x in sides]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    return sorted({r["item"] for row in found.collect() for r in row["top"] or [] if r["count"] > max(fewest, row["n"] // 100)})


class Tagged:
    """Rows of both sides with ``side`` 0 or 1 and a column for each name: a name of both sides, of one type, is one column."""

    def __init__(self, s: Side, t: Side):
        self.s, self.t = s, t
        self.places = {n: f"u{i}" for i, n in enumerate(dict.fromkeys((*s.names, *t.names)))}
        own = [x.rows.select(*x.on, F.lit(i).alias("side"), *[x.column(n).alias(self.places[n]) for n in x.names]) for i, x in enumerate((s, t))]
        self.rows = own[0].unionByName(own[1], allowMissingColumns=True)

    def order(self) -> list[Column]:
        """What stands first is the last row: by the order of its side, which for a side's rows is nothing else."""
        kinds = {n: k for x in (self.t, self.s) for n, (_, k) in x.fields.items()}
        by = lambda n: comparable(F.col(self.places[n]), kinds[n])
        merged = list(dict.fromkeys((*self.s.ordered, *self.t.ordered)))
        if [n for n in merged if n in self.t.ordered] == list(self.t.ordered):
            # columns of one side are null throughout the other
            return [by(n).desc_nulls_last() for n in merged]
        return [F.when(F.col("side") == i, by(n)).desc_nulls_last() for i, x in enumerate((self.s, self.t)) for n in x.ordered]

    def apart(self, rows: DataFrame, both: Column) -> DataFrame:
        """The columns of each side again: of rows with ``both``, the target's are those of the row ``other``."""
        mine = F.col("side") == 0
        here = [F.when(mine, F.col(self.places[n])).alias(f"s{i}") for i, n in enumerate(self.s.names)]
        there = [F.when(both, F.col("other")[self.places[n]]).when(~mine, F.col(self.places[n])).alias(f"t{i}") for i, n in enumerate(self.t.names)]
        return rows.select(*self.s.on, "in_s", "in_t", *here, *there)


def one_pass(s: Side, t: Side, any_flag: Column) -> DataFrame:
    """Rows of all changes with ``kind``: a modified row has both sides' columns, others their own side's.

    Names are of one type on both sides."""
    tagged = Tagged(s, t)
    here = Window.partitionBy(*s.on).orderBy("side", *tagged.order())
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = tagged.rows.repartition(*s.on).withColumns(
        {
            "in_s": F.first("side").over(whole) == 0,
            "in_t": F.last("side").over(whole) == 1,
            "leads": F.coalesce(F.lag("side").over(here) != F.col("side"), F.lit(True)),
        }
    )
    both = F.col("in_s") & F.col("in_t")
    next_ = F.lead(F.struct(*[tagged.places[n] for n in dict.fromkeys(t.names)])).over(here)
    paired = seen.where(~both | F.col("leads")).withColumn("other", next_)
    paired = tagged.apart(paired.where(~both | (F.col("side") == 0)), both)
    kind = F.when(~F.col("in_s"), "added").when(~F.col("in_t"), "deleted").when(any_flag, "modified")
    return paired.withColumn("kind", kind).where(F.col("kind").isNotNull())


def split_by_heat(s: Side, t: Side, shape: Callable[[DataFrame], DataFrame], any_flag: Column, joined: Callable[[Side, Side], DataFrame], fewest: int = FEWEST) -> DataFrame:
    """``shape`` of the one pass over both sides, and ``joined`` of the rows of hot keys, if there are any."""
    hot = hot_keys((s, t), fewest)
    if not hot:
        return shape(one_pass(s, t, any_flag))
    cold = [x.where(~key_hash(x).isin(hot)) for x in (s, t)]
    return shape(one_pass(*cold, any_flag)).unionByName(joined(*[x.where(key_hash(x).isin(hot)) for x in (s, t)]))
