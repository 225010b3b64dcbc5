import re

import numpy as np
import pytest
import xxhash

from rowdelta.llm import simhash


def brute_fp(text, k=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, t=4):
    fps = [brute_fp(x) for _, x in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= t:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, comp, strict=True)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (None, "one two three"), (7, "x" * 50_000)]
    for g in range(12):
        base = list(rng.choice(vocabulary, 120))
        for c in range(4):
            own = list(base)
            for _ in range(c):
                own[rng.integers(120)] = "zz"
            rows.append((100 + 10 * g + c, " ".join(own)))
    rows += rows[:4]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    for blocks in (None, 2):
        out = [tuple(r) for r in simhash.near_duplicates(docs, blocks=blocks).select("doc_id", "fingerprint", "component_id").collect()]
        assert sorted(out, key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("blocks,threshold", [(3, 4), (4, 7), (3, 0), (2, 4)])
def test_linked_pairs_share_an_anchor(blocks, threshold):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, threshold, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    held = []
    for fp in (x, y):
        who, what = simhash.anchors(fp, blocks, threshold)
        held.append(set(zip(who.tolist(), what.tolist(), strict=True)))
    assert {w for w, _ in held[0] & held[1]} == set(range(300))


def test_tiles_lose_no_link(spark):
    values = [int(x) for x in np.random.default_rng(3).integers(0, 1 << 9, 60)]
    rows = sorted({v << 3 for v in values})
    fps = spark.createDataFrame([(v,) for v in rows], "fp long")
    from rowdelta.llm.graph import components

    got = {r["node"]: r["component"] for r in components(simhash.links(fps, tile=4)).collect()}
    comp = {v: v for v in rows}
    for i in rows:
        for j in rows:
            if (i ^ j).bit_count() <= 4 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
    assert got == {k: c for k, c in comp.items() if list(comp.values()).count(c) > 1}
