"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size times. The whole part is certain; the fractions are
rounded in pairs: word mass moves at random from one document of a pair to the other until one of them is
whole, so that every expectation holds and the words of the pair do not change. A bounded group of documents
leaves one unsettled document, and these meet again in a reduction tree until each source has a single one.
A source's words thus miss its target by less than one document, and a small one: pairs are
made from the largest documents down.

Sources are rows of a table throughout. Equal rows are settled among themselves before any group: of m of them with
the fraction p, as many as m * p holds are taken once more, and one has the rest of m * p as its fraction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import parts, stored, text_key

WORD = r"[^\x20\x09-\x0D]+"


#: Plans of sources are broadcast up to this many (counted first) and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000
#: Rows of equal rows that one task makes at once.
_RUN = 1 << 16


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with sid: the place of each source by code point, null last. No task sees more than a range of them."""
    spark = sources.sparkSession
    dealt = sources.withColumn("no_source", F.col("source").isNull())
    dealt = stored(dealt.repartitionByRange("no_source", "source").withColumn("part", F.spark_partition_id()), "sources")
    held = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # as many rows as partitions
    before, starts = 0, []
    for part, count in held:
        starts.append((part, before))
        before += count
    starts = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("no_source", "source")) - 1
    return dealt.withColumn("sid", place).join(starts, "part").withColumn("sid", F.col("sid") + F.col("before")).drop("part", "before", "no_source")


def targets(sources: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (source, source_size, ...) with sid and target: its share of all sizes by weight, at most ``most``
    times its own size.

    Sources go by code point, null last, and take the weights in turn. What is over a source's limit is
    shared again by weight among the rest, until none is above. As the open share of a unit of weight only grows, it
    alone says which sources are closed. Up to ``BROADCAST_SOURCES`` sources are shared out on the driver; of more, each
    round is one aggregate."""
    sources = stored(sources, "totals")
    if sources.count() <= BROADCAST_SOURCES:
        return _targets_of_few(sources, most, weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    known = stored(numbered(sources).withColumn("weight", weight), "weights")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    closed = lambda unit: F.col("weight") * F.lit(unit) > F.lit(most) * F.col("source_size")
    unit, shut = 0.0, -1
    while True:
        over = closed(unit)
        n, size, open_ = known.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == shut or not open_:
            break
        unit, shut = max(unit, (total - most * (size or 0)) / open_), n
    return known.withColumn("target", F.when(closed(unit), F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * F.lit(unit))).drop("weight")


def _targets_of_few(sources: DataFrame, most: float, weights: tuple[int, ...]) -> DataFrame:
    found = sources.toArrow()
    name, size = found.column("source").to_pylist(), found.column("source_size").to_numpy()
    place = sorted(range(len(name)), key=lambda i: (name[i] is None, name[i] or ""))
    sid = np.empty(len(name), np.int64)
    sid[place] = np.arange(len(name))
    weight = np.array(weights)[sid % len(weights)]
    total, unit, shut = int(size.sum()), 0.0, -1
    while True:
        over = weight * unit > most * size
        n, open_ = int(over.sum()), int(weight[~over].sum())
        if n == shut or not open_:
            break
        unit, shut = max(unit, (total - most * int(size[over].sum())) / open_), n
    target = np.where(weight * unit > most * size, most * size, weight * unit)
    rows = found.append_column("sid", pa.array(sid)).append_column("target", pa.array(target, pa.float64()))
    return sources.sparkSession.createDataFrame(rows) if len(name) else sources.withColumns({"sid": F.lit(0).cast("long"), "target": F.lit(0.0)})


def settle(size: np.ndarray, copies: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int:
    """Round the fractions p, in place, into copies. Returns the unsettled row, or -1 if there is none."""
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1 or size[i] == 0:
            continue
        if held < 0:
            held = i
            continue
        j = held
        gain, loss = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        # i gains words of j with the odds that keep both expectations; what reaches its end is exactly whole
        if draws[i] * (gain + loss) < loss:
            i_ends, j_ends = (1 - p[i]) * size[i] <= gain, p[j] * size[j] <= gain
            p[i], p[j] = 1.0 if i_ends else p[i] + gain / size[i], 0.0 if j_ends else p[j] - gain / size[j]
        else:
            i_ends, j_ends = p[i] * size[i] <= loss, (1 - p[j]) * size[j] <= loss
            p[i], p[j] = 0.0 if i_ends else p[i] - loss / size[i], 1.0 if j_ends else p[j] + loss / size[j]
        held = next((k for k in (j, i) if 0 < p[k] < 1), -1)
    none = (size == 0) & (p > 0) & (p < 1)
    p[none] = draws[none] < p[none]
    return held


def mix(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), group: int = 1024, fan_in: int = 256, seed: int = 10) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies and taken for each row of ``docs`` (doc_id, text, source).

    size is the number of words ``[^\\x20\\x09-\\x0D]+`` (0 for null and empty texts), target that of the row's
    source, copies the times the mix takes the document and taken = copies * size. No document is taken more
    than ``most`` times if that is a whole number.

    A null source is a source, ordered last. Only equal rows may swap results; reruns agree. Any number of sources and
    of equal rows will do: the driver holds totals only. Other columns are ignored. An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_hash"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = stored(rows.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("m")), "sizes")
    total = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = stored(targets(total, most, weights).select("sid", F.col("source").alias("name"), "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / group).alias("groups")), "plan")
    sources, groups = plan.agg(F.count("*"), F.coalesce(F.max("groups"), F.lit(1))).first()
    plan = F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("name")))
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("groups")))
    whole = F.floor("rate").cast("int")
    more = F.col("m") * (F.col("rate") - whole)
    # ``up`` of the m rows are taken once more for certain, one of the rest with what is left as its odds
    up = F.least(F.floor(more), F.col("m") - 1)
    dealt = dealt.select("sid", "grp", "doc_id", "text_hash", "size", "m", up.alias("up"), whole.alias("copies"), (more - up).alias("p"))

    def rounded(level: int, last: bool):
        def f(table: pa.Table) -> pa.Table:
            # largest first: documents settle against others of their size, and what stays open is small
            table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("p", "ascending"), ("grp", "ascending")])
            n, copies, p = (table.column(c).to_numpy().copy() for c in ("size", "copies", "p"))
            key = table.column("sid")[0].as_py(), table.column("parent")[0].as_py()
            rng = np.random.Generator(np.random.PCG64([seed, level, *key]))
            held = settle(n, copies, p, rng)
            if last and held >= 0:
                p[held], held = float(rng.random() < p[held]), -1
            open_ = np.zeros(len(p), bool)
            if held >= 0:
                open_[held] = True
            rows = {c: table.column(c) for c in ("sid", "doc_id", "text_hash", "size", "m", "up", "copies")}
            return pa.table(rows | {"grp": table.column("parent"), "p": pa.array(np.where(open_, p, np.rint(p))), "open": pa.array(open_)})

        return f

    schema = "sid long, doc_id long, text_hash long, size long, m long, up long, copies int, grp long, p double, open boolean"
    now, level, done = dealt.withColumn("parent", F.col("grp")), 0, None
    while True:
        made = stored(now.groupBy("sid", "parent").applyInArrow(rounded(level, groups <= 1), schema), "rounded")
        settled = made.where("not open")
        done = settled if done is None else done.unionByName(settled)
        if groups <= 1:
            break
        groups, level = math.ceil(groups / fan_in), level + 1
        parent = F.lit(0).cast("long") if groups == 1 else F.expr(f"grp div {fan_in}")
        now = made.where("open").drop("open").withColumn("parent", parent)
    # a row again for each of the m equal ones
    done = done.join(plan, "sid").withColumn("up", F.col("up") + F.rint("p").cast("long"))
    run = F.explode(F.expr(f"sequence(0L, (m - 1) div {_RUN})"))
    few, many = done.where(F.col("m") <= _RUN).withColumn("run", F.lit(0).cast("long")), done.where(F.col("m") > _RUN).withColumn("run", run)
    each = few.unionByName(many.repartition(parts(spark), "sid", "doc_id", "text_hash", "run"))
    each = each.withColumn("k", F.explode(F.expr(f"sequence(run * {_RUN}, least((run + 1) * {_RUN}, m) - 1)")))
    copies = F.col("copies") + (F.col("k") < F.col("up")).cast("int")
    out = each.select("doc_id", "text_hash", F.col("name").alias("source"), "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))
