import re
from collections import defaultdict

import numpy as np
import pytest

from rowdelta.llm import mixing


def brute_targets(sizes):
    """Share by weight, cut at three times the size, share the rest again, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    got = dict.fromkeys(order, 0.0)
    capped, extra = set(), float(sum(sizes.values()))
    while extra > 1e-9 and len(capped) < len(order):
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += extra * weight[s] / total
        extra = 0.0
        for s in open_:
            if got[s] > 3 * sizes[s]:
                extra += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                capped.add(s)
    return got


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 5, "b": 1000, "c": 1, None: 3}, {"é": 10, "z": 10, "Z": 10, None: 10}, {"a": 0, "b": 9}, {}, {"a": 0}])
def test_targets(spark, sizes, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    out, want = mixing.targets(table).collect(), brute_targets(sizes)
    got = {r["source"]: r["target"] for r in out}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert [r["source"] for r in sorted(out, key=lambda r: r["sid"])] == list(want) and sorted(r["sid"] for r in out) == list(range(len(out)))


def test_pairs_keep_words_and_expectations():
    rng = np.random.default_rng(0)
    size = np.array([900, 400, 399, 50, 50, 7, 0, 3])
    total = np.zeros(len(size))
    for _ in range(4000):
        p = np.full(len(size), 0.3)
        held = mixing.settle(size, np.zeros(len(size)), p, rng)
        assert ((p == 0) | (p == 1) | (np.arange(len(p)) == held)).all()
        assert abs((p * size).sum() - 0.3 * size.sum()) < 1e-6
        total += p
    assert np.abs(total / 4000 - 0.3).max() < 0.04


@pytest.mark.parametrize("group,fan_in", [(1024, 256), (5, 2)])
def test_mix(spark, group, fan_in):
    rng = np.random.default_rng(1)
    rows = [(None, None, "a"), (0, "", None), (1, None, "b"), (2, " \n\t\x0b", "a"), (3, "w " * 5000, "a")]
    for d in range(10, 400):
        source = "hot" if d % 3 == 0 else ["a", "b", "é", None][d % 4]
        rows.append((d, " ".join(["wörd"] * int(rng.integers(0, 60))), source))
    rows += rows[20:25]
    docs = spark.createDataFrame([(d, t, s, 1, 0.5) for d, t, s in rows], "doc_id long, text string, source string, grp int, p double")
    out = mixing.mix(docs, group=group, fan_in=fan_in).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want, taken = brute_targets(size), defaultdict(int)
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert abs(r["copies"] - r["target"] / r["source_size"]) < 1
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 60 or s == "a" and abs(taken[s] - want[s]) <= 5000 for s in want)
    again = mixing.mix(docs.repartition(3), group=group, fan_in=fan_in).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_many_sources_are_joined(spark, monkeypatch):
    """More sources than are broadcast give the same mix."""
    docs = spark.createDataFrame([(d, "w " * (d % 17), f"s{d % 300}") for d in range(2000)], "doc_id long, text string, source string")
    some = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(map(str, mixing.mix(docs).collect())) == some
    want = brute_targets({f"s{i}": sum(d % 17 for d in range(i, 2000, 300)) for i in range(300)})
    got = defaultdict(int)
    for r in mixing.mix(docs).collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - want[s]) < 17 for s in want)


def test_equal_rows_share_their_copies(spark, monkeypatch):
    """A third of all rows are one row: each has a result, their sum keeps the target, and no group holds them."""
    monkeypatch.setattr(mixing, "_RUN", 64)
    rows = [(None, "a b c", "x")] * 1000 + [(d, "w " * (1 + d % 5), "xyz"[d % 3]) for d in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group=50).collect()
    assert len(out) == 3000
    for s in "xyz":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    same = [r["copies"] for r in out if r["doc_id"] is None]
    assert len(same) == 1000 and max(same) - min(same) <= 1 and all(abs(c - out_rate(out)) < 1 for c in same)


def out_rate(out):
    return next(r["target"] / r["source_size"] for r in out if r["source"] == "x")


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
