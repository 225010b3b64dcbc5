"""SimHash fingerprints of word shingles, linked through the anchors of a covering code.

The 64 bits fall into ``blocks`` of about equal width. Fingerprints that differ in at most t bits differ in
at most t // blocks bits within some block. Each block is covered by the perfect binary Golay code: every
23-bit word lies within three bits of a codeword, the anchor; bits of a wider block belong to the anchor as
they are. A fingerprint is copied to every anchor within
covering radius plus the block's threshold, so for a linked pair the anchor nearest to one of them also holds
the other. Fingerprints are compared per anchor only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import parts, stored, text_key
from .graph import components, local_stars
from .tokens import Words, slices

BITS, LENGTH, RADIUS = 64, 23, 3
FEW = 16_000_000
#: Copies that a task compares at once, tile by tile.
GROUP = 1 << 18
#: x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1, a generator of the [23, 12] Golay code.
GENERATOR = 0b110001110101


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) for each row: fp is the 64-bit SimHash, as a signed long, of the text's word shingles.

    A-Z is lower-cased; words are runs outside ``[\\x20\\x09-\\x0D]``; a shingle's hash is XXH64 with seed 42 of
    its words with one space between. A text of fewer words is one shingle; no words or null: fingerprint 0.
    A bit is 1 if it is set in over half of the hashes.
    """

    def per_batch(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = pa.array(_fingerprints(batch.column("text"), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), text_key(text).alias("text_hash"))
    return docs.mapInArrow(per_batch, "doc_id long, text_hash long, fp long")


def _fingerprints(texts: pa.Array, k: int) -> np.ndarray:
    words = Words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    length = words.ends - words.starts
    xx = xxhash.xxh64_intdigest
    for d in range(len(texts)):
        a, b = words.by_doc[d], words.by_doc[d + 1]
        if a == b:
            continue
        line = words.joined(d)
        n = max(b - a - k + 1, 1)
        starts = np.zeros(b - a, np.int64)
        np.cumsum(length[a : b - 1] + 1, out=starts[1:])
        ends = (starts + length[a:b])[min(k, b - a) - 1 :]
        hashes = np.fromiter((xx(line[i:j], 42) for i, j in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator."""
    r = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - 11), 0)
    return r


def _flips(bits: int, reach: int) -> np.ndarray:
    """All words of ``bits`` bits with up to ``reach`` ones."""
    one = np.int64(1) << np.arange(bits, dtype=np.int64)
    level, found = np.zeros(1, np.int64), [np.zeros(1, np.int64)]
    for n in range(1, min(reach, bits) + 1):
        level = np.unique((level[:, None] | one[None, :]).ravel())
        level = level[np.bitwise_count(level) == n]
        found.append(level)
    return np.concatenate(found)


@lru_cache(maxsize=8)
def _near(rest: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """What to flip in a block of 23 + ``rest`` bits to get its anchors, by the syndrome of the low 23 bits.

    The rest is an anchor's as it is, with radius zero, so flips there take from the threshold.
    patterns[start[s]:start[s + 1]] are those of syndrome s."""
    high = _flips(rest, threshold)
    patterns = np.concatenate([_flips(LENGTH, RADIUS + threshold - int(np.bitwise_count(h))) | (h << LENGTH) for h in high])
    s = _syndromes(patterns & ((1 << LENGTH) - 1))
    order = np.argsort(s, kind="stable")
    return patterns[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))


def anchors(fp: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) of all copies. An anchor is block << 60 | codeword and rest."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    who, what = [], []
    for i in range(blocks):
        width = edges[i + 1] - edges[i]
        value = ((fp >> np.uint64(edges[i])) & np.uint64((1 << width) - 1)).astype(np.int64)
        patterns, start = _near(max(width - LENGTH, 0), threshold // blocks)
        s = _syndromes(value & ((1 << LENGTH) - 1))
        n = start[s + 1] - start[s]
        row = np.repeat(np.arange(len(fp)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
        who.append(row)
        what.append((i << 60) | (value[row] ^ patterns[at]))
    return np.concatenate(who), np.concatenate(what)


def links(fps: DataFrame, threshold: int = 4, blocks: int | None = None, tile: int = 2048) -> DataFrame:
    """Star edges (src, dst) over the distinct values of ``fps.fp`` whose components are those of all linked pairs.

    An anchor holding over ``tile`` fingerprints is cut into k stripes and compared as k * (k + 1) / 2 tiles
    of two stripes, so that no anchor needs more memory than a tile; tiles are dealt into groups of bounded rows. Any number of
    blocks gives the same components: three make about 16 copies at 12 thousand anchors, two about 210 at four
    million, which is less work for more than ``FEW`` fingerprints.
    """
    blocks = blocks or (3 if fps.count() <= FEW else 2)

    def copies(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 1 << 13):
                who, what = anchors(fp[at : at + (1 << 13)], blocks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at + who].view(np.int64)), pa.array(what)], ["fp", "anchor"])

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        anchor, tile_no = table.column("anchor").to_numpy(), table.column("tile").to_numpy()
        order = np.lexsort((fp, tile_no, anchor))
        fp, anchor, tile_no = fp[order], anchor[order], tile_no[order]
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(tile_no) != 0)) + 1
        left, right = [], []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
            own = np.unique(fp[lo:hi])
            for i in range(0, len(own), 256):
                a, b = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, i + 1 :]) <= threshold)
                keep = b >= a
                if keep.any():
                    x, y = local_stars(own[i + a[keep]].view(np.int64), own[i + 1 + b[keep]].view(np.int64))
                    left.append(x)
                    right.append(y)
        none = np.zeros(0, np.int64)
        a, b = local_stars(np.concatenate([none, *left]), np.concatenate([none, *right]))
        return pa.table({"src": a, "dst": b})

    spark = ship(fps.sparkSession)
    held = stored(fps.select("fp").mapInArrow(copies, "fp long, anchor long"), "anchors")
    heavy = stored(held.groupBy("anchor").count().where(F.col("count") > tile), "heavy")
    more = heavy.agg(F.coalesce(F.sum(F.col("count") * (F.ceil(F.col("count") / tile) - 1)), F.lit(0))).first()[0]
    # a group is some whole tiles of about GROUP rows in all
    groups = max(8 * parts(spark), (held.count() + more) // GROUP)
    n = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tile)
    stripe = F.when(n > 1, F.pmod(F.xxhash64("fp"), n)).otherwise(F.lit(0))
    # a stripe meets every other: tile (i, j), i <= j
    tiled = held.join(heavy, "anchor", "left").withColumn("n", n).withColumn("s", stripe)
    tiled = tiled.select("fp", "anchor", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.least(j, F.col("s")) * F.col("n") + F.greatest(j, F.col("s")))).alias("tile"))
    dealt = tiled.withColumn("deal", F.pmod(F.xxhash64("anchor", "tile"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 lowercase hex digits), component and component_id for each row of ``docs``.

    Documents link if their fingerprints differ in at most ``threshold`` bits; component_id is the smallest
    doc_id reachable by links, itself included. Equal fingerprints are one node, so a group of copies of any
    size costs one comparison. Null and empty texts have fingerprint 0 and link like any other. Rows with a
    null doc_id get a component like others; null is never the smallest unless the component has no other id.
    component names the group itself (its least fingerprint as a signed long).
    """
    own = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, threshold, blocks))
    grouped = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "component").select("fp", "component", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(named, "fp").select("doc_id", "text_hash", shown, "component", "component_id")
