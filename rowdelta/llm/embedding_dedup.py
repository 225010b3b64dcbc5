"""Exact threshold pairs of embeddings by cover trees and dual traversal.

On unit vectors, cosine >= c is Euclidean distance <= t = sqrt(2 - 2c). A cover tree has nested levels whose
radii halve: every point lies within a level's radius of one of the level's centres, and the centres of a
level are centres of all finer ones. Two trees are compared by descending both at once: a pair of nodes whose
centres are further apart than t plus both covering radii is pruned with all below it, a pair whose centres
plus both covering radii are within t is linked as a whole, and only what remains is opened.

The upper levels are those of a bounded sample: every vector goes to its nearest centre of the finest of them, to
an inner or an outer cell by its distance, which gives each node its true covering radius, and the dual traversal of
these nodes says which cells can hold a link. Neighbouring cells make bins of bounded number, bins blocks of bounded rows. Each block grows the lower
levels, and pairs of blocks that survived are traversed in tasks of their own. A level that would have nearly as
many nodes as points, as in data without near points, is not built, and rows are compared below it.

Equal vectors are one point with a weight, and a block pair returns counts and star edges, never its pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import parts, stored
from .graph import components, local_stars

#: Far over the error of a distance computed from a dot product; nodes this near a bound are opened.
ROUNDING = 1e-6
#: A product in single precision of at most WIDE components is off by less than ROUGH; what is near is checked in double.
ROUGH, WIDE = 1e-3, 4096
#: Sampled points that make cells (at most, and one for so many vectors), and bins of cells.
MOST_CELLS, PER_CELL, MOST_BINS = 4096, 64, 1024
#: Within this distance of its centre a vector is in the centre's inner cell.
TIGHT = 0.5
#: Of a side's rows in a task, and of the sample on the driver.
SIDE_BYTES, SAMPLE_BYTES = 16 << 20, 32 << 20
#: Distances of nodes that are held at once.
AT_ONCE = 1 << 22

Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def unit(embedding: pa.Array) -> np.ndarray:
    """The unit vectors of lists of one length, none null or zero."""
    lists = embedding.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    width = int(offsets[1] - offsets[0]) if len(lists) else 0
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return normal(flat.reshape(len(lists), width))


def normal(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, initial=0)
    x = x / np.where(scale > 0, scale, 1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the unit vectors of a and of b."""
    d = a @ b.T
    d *= -2
    d += 2
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def tree(x: np.ndarray, top: float, levels: int, most: int | None = None) -> list[Level]:
    """Nested covers of the rows of x with radii top, top / 2, ...

    Each level is (centres as row numbers, each row's node at that level, covering radius of each node). A
    node's points are those of its children, a node's centre is one of its children's. Levels of more than ``most``
    nodes are not built, nor are finer ones."""
    out: list[Level] = []
    groups = [np.arange(len(x))] if len(x) else []
    for k in range(levels):
        radius = top / 2**k
        if most is not None and not _coverable(x, radius, most):
            break
        centres, reach, inside = [], [], []
        for rest in groups:  # a group begins with its centre
            while len(rest) and (most is None or len(centres) <= most):
                d = distances(x[rest[:1]], x[rest])[0]
                d[0] = 0
                near = d <= radius
                centres.append(rest[0])
                reach.append(d[near].max())
                inside.append(rest[near])
                rest = rest[~near]
        if most is not None and len(centres) > most:
            break
        node = np.empty(len(x), np.int64)
        for n, own in enumerate(inside):
            node[own] = n
        out.append((np.array(centres, np.int64), node, np.array(reach) + ROUNDING))
        groups = inside
    return out


def _coverable(x: np.ndarray, radius: float, most: int) -> bool:
    """Whether a level of ``most`` nodes is likely: points without another in reach are nodes of their own."""
    if len(x) <= most:
        return False
    some = np.linspace(0, len(x) - 1, min(64, len(x))).astype(int)
    alone = (distances(x[some], x) <= radius).sum(1) == 1
    return alone.mean() * len(x) <= most


def open_pairs(a: list[Level], xa: np.ndarray, b: list[Level], xb: np.ndarray, t: float, link: bool = True):
    """Descend two trees. Returns the level reached, its open node pairs (boolean), and (level, i, j) of all node pairs
    that are linked as a whole; without ``link`` those are opened like others."""
    open_, whole = np.ones((1, 1), bool), []
    pa_, pb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    level = -1
    for level, ((ca, na, ra), (cb, nb, rb)) in enumerate(zip(a, b, strict=False)):
        ask = open_[pa_[ca][:, None], pb[cb][None, :]]
        open_ = np.zeros(ask.shape, bool)
        strip = max(1, AT_ONCE // max(1, len(cb)))
        for at in range(0, len(ca), strip):
            own = slice(at, at + strip)
            d = distances(xa[ca[own]], xb[cb])
            both = ra[own, None] + rb[None, :]
            linked = ask[own] & (d + both < t - ROUNDING) if link else np.zeros(d.shape, bool)
            open_[own] = ask[own] & ~linked & (d - both <= t + ROUNDING)
            whole += [(level, at + i, j) for i, j in zip(*np.nonzero(linked), strict=True)]
        pa_, pb = na, nb
        if not open_.any():
            break
    return level, open_, whole


def bin_pairs_of(met: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of bins, the lower first, that hold a pair of cells of the matrix ``met``."""
    n = bins.max(initial=-1) + 1
    out = np.zeros((n, n), bool)
    for c in range(len(met)):
        out[bins[c], bins[met[c]]] = True
    return np.nonzero(np.triu(out | out.T))


def near(xa: np.ndarray, fa: np.ndarray, xb: np.ndarray, fb: np.ndarray, least: float) -> np.ndarray:
    """Which rows have a cosine of ``least`` in double precision; fa and fb are the rows in single precision."""
    if xa.shape[1] > WIDE:
        return xa @ xb.T >= least
    maybe = fa @ fb.T >= np.float32(least - ROUGH)
    i, j = np.nonzero(maybe)
    if len(i) > maybe.size // 50:
        return xa @ xb.T >= least
    for at in range(0, len(i), 1 << 14):
        u, v = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        maybe[u, v] = np.einsum("ij,ij->i", xa[u], xb[v]) >= least
    return maybe


class Block:
    """The rows of a block in a task: unit vectors, weights, node numbers and tree."""

    def __init__(self, r: dict, kind: str):
        self.name = r["block"]
        self.x = normal(np.frombuffer(r["x"], kind).reshape(-1, r["width"]).astype(float))
        self.f = self.x.astype(np.float32)
        self.weight, self.node = (np.frombuffer(r[k], np.int64) for k in ("weight", "node"))
        self.tree: list[Level] = pickle.loads(r["tree"])

    def rows(self, level: int, n: int) -> np.ndarray:
        return np.flatnonzero(self.tree[level][1] == n)


def dual(a: Block, b: Block, least: float):
    """(rows of a, rows of b, link) of all parts of the pair that were compared or linked as a whole.

    link is a boolean matrix, or None where all link."""
    t = np.sqrt(max(0.0, 2 - 2 * least))
    level, open_, whole = open_pairs(a.tree, a.x, b.tree, b.x, t)
    for k, i, j in whole:
        yield a.rows(k, i), b.rows(k, j), None
    if not open_.any():
        return
    if level < 0:
        strips = [(np.arange(len(a.x)), np.arange(len(b.x)))]
    else:
        na, nb = a.tree[level][1], b.tree[level][1]
        share = (open_ * np.bincount(na, minlength=len(open_))[:, None] * np.bincount(nb, minlength=open_.shape[1])[None, :]).sum() / (len(na) * len(nb))
        if share > 0.5 and not whole:
            strips = [(np.arange(len(na)), np.arange(len(nb)))]
        else:
            # nodes of a that are open to the same nodes of b are compared at once
            ways, which = np.unique(open_, axis=0, return_inverse=True)
            strips = [(np.flatnonzero(which.ravel()[na] == w), np.flatnonzero(way[nb])) for w, way in enumerate(ways)]
    for rows, cols in strips:
        for at in range(0, len(rows) if len(cols) else 0, 256):
            own = rows[at : at + 256]
            yield own, cols, near(a.x[own], a.f[own], b.x[cols], b.f[cols], least)


def linked(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a pair of blocks: nodes with links and their numbers of links, star edges, and how many pairs of rows were compared."""
    same, compared = a.name == b.name, 0
    ka, kb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    stars = [(np.zeros(0, np.int64),) * 2]
    for rows, cols, link in dual(a, b, least):
        if link is None:
            ka[rows] += b.weight[cols].sum()
            kb[cols] += a.weight[rows].sum()
            if same:  # not with themselves
                both = np.intersect1d(rows, cols)
                ka[both] -= b.weight[both]
            u, v = np.concatenate([rows, np.full(len(cols), rows[0])]), np.concatenate([np.full(len(rows), cols[0]), cols])
        else:
            compared += link.size // 2 if same else link.size
            if same:
                link[rows[:, None] == cols[None, :]] = False
            u, v = np.nonzero(link)
            if not len(u):
                continue
            ka[rows] += link @ b.weight[cols]
            kb[cols] += link.T @ a.weight[rows]
            u, v = rows[u], cols[v]
        stars.append(local_stars(a.node[u], b.node[v]))
    n, k = (a.node, ka) if same else (np.concatenate([a.node, b.node]), np.concatenate([ka, kb]))
    u, v = local_stars(*(np.concatenate(s) for s in zip(*stars, strict=True)))
    return n[k > 0], k[k > 0], u, v, compared


def coarse(sample: dict[int, np.ndarray], levels: int) -> dict[int, list[Level]]:
    """The upper levels of each width, the last of which has every sampled point as a node."""
    out = {}
    for w, x in sample.items():
        grown = tree(x, 1.0, levels)
        out[w] = [*grown, (np.arange(len(x)), np.arange(len(x)), np.zeros(len(x)))]
    return out


def bins_of(rows: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """A bin for each cell: neighbours in ``order`` share one while they hold at most ``most`` rows."""
    out, held, now = np.zeros(len(rows), np.int64), 0, 0
    for c in order:
        if held and held + rows[c] > most:
            now, held = now + 1, 0
        out[c], held = now, held + rows[c]
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9, block: int | None = None, cells: int | None = None, levels: int = 3, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    All rows are compared with all others by cosine in double precision and link at ``least`` or more (which
    must be over 0). A vector that is null, empty, zero or holds a null or non-finite component links with
    nothing; so do vectors of different lengths with each other. n_links counts the other rows linked
    directly, component_id is the smallest vec_id reachable, kept says whether that is the row itself.

    Every row is a vector of its own, also if its vec_id is null or repeated: rows are joined by their links alone.
    A component whose rows all have null ids has a null component_id. Other columns are ignored. An empty table
    gives an empty result.

    ``block`` bounds the rows that a task holds of a side (1,024 to 8,192 by size if not given); ``cells`` is the sample
    whose cover tree makes the cells, one for ``PER_CELL`` vectors and at most ``MOST_CELLS`` if not given. A
    ``report`` is filled with the numbers of block pairs and pairs of rows that were compared, and those of all.
    """
    spark = ship(vectors.sparkSession)
    kind = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    e = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(e, lambda v: v + 0.0)).alias("e"))
    # equal vectors are known by 128 bits of hash
    rows = rows.select("vec_id", "e", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("h"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit("#"), "e")).otherwise(F.xxhash64("vec_id")).alias("g"))
    points = rows.where("e is not null").groupBy("h", "g").agg(F.first("e").alias("e"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    # numbered once, as written
    points = stored(points.select(F.monotonically_increasing_id().alias("node"), F.size("e").alias("width"), "e", "weight", "low", "h", "g"), "points")

    total, widest = points.agg(F.count("*"), F.max("width")).first()
    block = block or int(np.clip(total // parts(spark), 1024, np.clip(SIDE_BYTES // (8 * (widest or 1)), 1024, 8192)))
    cells = cells or int(np.clip(total // PER_CELL, 8, np.clip(SAMPLE_BYTES // (8 * (widest or 1)), 8, MOST_CELLS)))
    found = points.orderBy("h", "g").limit(cells).select("width", "e").toArrow()
    of_width = found.column("width").to_numpy()
    sample = {int(w): unit(found.filter(pa.array(of_width == w)).column("e").combine_chunks()) for w in np.unique(of_width)}
    trees = coarse(sample, levels)
    # of each width: each cell's centre at every level
    paths = {w: np.stack([centre[node] for centre, node, _ in trees[w]]) for w in trees}
    sent = spark.sparkContext.broadcast((sample, paths))

    def place(batches):
        sample, paths = sent.value
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width):
                own = batch.filter(pa.array(width == w))
                x = unit(own.column("e"))
                cell, reach = np.zeros(len(x), np.int32), [[2.0]] * len(x)
                if int(w) in sample:
                    centres = sample[int(w)]
                    cell = np.concatenate([(x[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(x), 1024)]).astype(np.int32)
                    reach = np.stack([np.sqrt(((x - centres[at[cell]]) ** 2).sum(1)) for at in paths[int(w)]], 1)
                    # points far from any centre have cells of their own, so that the others' stay small
                    cell, reach = (2 * cell + (reach[:, -1] > TIGHT)).astype(np.int32), reach.tolist()
                raw = own.column("e").flatten().to_numpy().astype(kind).reshape(len(x), int(w))
                columns = [own.column("width"), pa.array(cell), pa.array(reach, pa.list_(pa.float64())), pa.array([v.tobytes() for v in raw], pa.binary()), own.column("weight"), own.column("node")]
                yield pa.RecordBatch.from_arrays(columns, ["width", "cell", "reach", "x", "weight", "node"])

    dealt = stored(points.mapInArrow(place, "width int, cell int, reach array<double>, x binary, weight long, node long"), "cells")
    sizes = dealt.groupBy("width", "cell").agg(F.count("*").alias("n"), *(F.max(F.try_element_at("reach", F.lit(k + 1))).alias(f"r{k}") for k in range(levels + 1)))

    # dual traversal of the upper levels, on the driver: at most ``cells`` nodes; unsampled lengths have one cell each
    t = float(np.sqrt(2 - 2 * least))
    held = [r.asDict() for r in sizes.where(F.col("width").isin(list(trees))).collect()]
    named, meet, most = [], [MEET.empty_table()], max(block, -(-total // MOST_BINS))
    for w, grown in trees.items():
        # two cells of each sampled point
        centres = np.repeat(sample[w], 2, 0)
        grown = [(2 * centre, np.repeat(node, 2), None) for centre, node, _ in grown]
        grown.append((np.arange(len(centres)), np.arange(len(centres)), None))
        n = np.zeros(len(centres), np.int64)
        far = np.zeros((len(grown), len(n)))
        for r in held:
            if r["width"] == w:
                n[r["cell"]] = r["n"]
                own = [r[f"r{k}"] for k in range(len(grown) - 1)]
                far[:, r["cell"]] = [*own, own[-1]]
        true = []
        for k, (centre, node, _) in enumerate(grown):
            reach = np.zeros(len(centre))
            np.maximum.at(reach, node, far[k])
            true.append((centre, node, reach + ROUNDING))
        # all that is not pruned: blocks count links, so no node pair is linked as a whole here
        _, open_, _ = open_pairs(true, centres, true, centres, t, link=False)
        last = open_ if open_.shape == (len(n), len(n)) else np.zeros((len(n), len(n)), bool)
        # neighbours in the tree beside each other, the far ones after all others
        bins = bins_of(n, np.lexsort([*[node for _, node, _ in grown][::-1], np.arange(len(n)) % 2]), most)
        last &= (n > 0)[:, None] & (n > 0)[None, :]
        i, j = bin_pairs_of(last, bins)
        meet.append(pa.table({"width": np.full(len(i), w, np.int32), "ca": i, "cb": j}, schema=MEET))
        named += [(w, int(c), int(bins[c])) for c in np.flatnonzero(n)]
    named = spark.createDataFrame(named, "width int, cell int, bin long")
    other = ~F.col("width").isin(list(trees))
    named = F.broadcast(named)  # at most a row for each sampled point
    placed = dealt.join(named, ["width", "cell"], "left").withColumn("bin", F.coalesce("bin", F.lit(0).cast("long")))
    parts_of = placed.groupBy("width", "bin").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    parts_of = stored(parts_of, "bins")
    bin_pairs = spark.createDataFrame(pa.concat_tables(meet)).unionByName(parts_of.where(other).select("width", F.col("bin").alias("ca"), F.col("bin").alias("cb")))
    of = parts_of.select("width", "bin", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    pairs = bin_pairs.join(of.select("width", F.col("bin").alias("ca"), F.col("part").alias("i")), ["width", "ca"]).join(of.select("width", F.col("bin").alias("cb"), F.col("part").alias("j")), ["width", "cb"]).where("ca < cb or i <= j")
    pairs = pairs.select(F.concat_ws(":", "width", "ca", "i").alias("a"), F.concat_ws(":", "width", "cb", "j").alias("b"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("node", "ascending")])
        x = b"".join(table.column("x").to_pylist())
        width = table.column("width")[0].as_py()
        grown = tree(normal(np.frombuffer(x, kind).reshape(-1, width).astype(float)), 0.5, levels, table.num_rows // 8)
        one = {"block": table.column("block")[0].as_py(), "width": width, "x": x, "tree": pickle.dumps([(c.astype(np.int32), n.astype(np.int32), r) for c, n, r in grown])}
        one |= {k: table.column(k).to_numpy().tobytes() for k in ("weight", "node")}
        return pa.Table.from_pylist([one], schema=PACKED)

    part = F.pmod(F.xxhash64("node"), F.col("k"))
    blocks = placed.join(parts_of, ["width", "bin"]).select(F.concat_ws(":", "width", "bin", part.cast("int")).alias("block"), "width", "cell", "x", "weight", "node")
    packed = stored(blocks.groupBy("block").applyInArrow(pack, "block string, width int, x binary, tree binary, weight binary, node binary"), "packed")

    def compare(batches):
        mine = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                b = Block(r, kind)
                if r["block"] == r["host"]:  # sorted to be a host's first guest
                    mine = b
                n, k, u, v, compared = linked(mine, b, least)
                rows = (np.concatenate([n, u, [compared]]), np.concatenate([k, v, [0]]), np.repeat([0, 1, 2], [len(n), len(u), 1]))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in rows], ["node", "other", "what"])

    # one side of a pair is the host, which a task holds, and the other its guest, which is sent there; a row is one block
    even = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    guests = pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("block"))
    work = guests.join(packed, "block").repartition(4 * parts(spark), "host").sortWithinPartitions("host", F.col("block") != F.col("host"))
    out = stored(work.mapInArrow(compare, "node long, other long, what long"), "links")
    if report is not None:
        blocks_ = parts_of.groupBy("width").agg(F.sum("k").alias("k")).agg(F.sum(F.expr("k * (k + 1) div 2"))).first()[0]
        report |= {"block_pairs": out.where("what = 2").count(), "all_block_pairs": blocks_, "compared": out.where("what = 2").agg(F.sum("node")).first()[0], "all": total * (total + 1) // 2}
    counts = out.where("what = 0").groupBy("node").agg(F.sum("other").alias("links"))
    found = components(out.where("what = 1").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    known = points.select("node", "weight", "low", "h", "g").join(counts, "node", "left").join(found, "node", "left")
    known = known.select("h", "g", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least_ids = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(least_ids, "component").select("h", "g", "n_links", "component_id", F.lit(True).alias("good"))
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", "h", "g").join(known, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


MEET = pa.schema([("width", pa.int32()), ("ca", pa.int64()), ("cb", pa.int64())])
PACKED = pa.schema([("block", pa.string()), ("width", pa.int32()), ("x", pa.binary()), ("tree", pa.binary()), ("weight", pa.binary()), ("node", pa.binary())])
