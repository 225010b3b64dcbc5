"""Connected components over DataFrames: alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b reduced to (node, smallest node of its component), without the roots' own rows."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the smallest node reachable.

    Each round does a large-star step (the larger neighbours of a node link to its smallest neighbour) and a
    small-star step (a node and its smaller neighbours link to the smallest of them); rounds end when the
    edges no longer change, which takes about log of the diameter. The edges of a round are written to the
    shared folder. Self loops give a component of one node.

    Minima are pre-aggregated before their shuffle and written too: a join of two tables as read can be split
    by adaptive execution, so a node with very many neighbours needs no task of its own.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("dst").alias("low"))
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # every node u of `large` has only smaller neighbours v
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        for old in (now, low, large, least):
            forget(old)
        now, was, mark = after, mark, _mark(after)
        if was == mark:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("low")).unionByName(loops).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("low")))
    return found.groupBy("node").agg(F.min("low").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
