import numpy as np

from rowdelta.llm import embedding_dedup
from rowdelta.llm.embedding_dedup import Block, dual, linked, near_duplicates, normal, tree


def brute(rows, least=0.9):
    ok = [i for i, (_, e) in enumerate(rows) if e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in ok}
    comp, links = list(range(len(rows))), [0] * len(rows)
    for i in ok:
        for j in ok:
            if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    lows = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    return sorted(((r[0], links[i], lows[comp[i]], r[0] is not None and r[0] == lows[comp[i]]) for i, r in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [float("nan")] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, [1.0, 2.1])]
    for g in range(15):
        c = rng.normal(size=8)
        for k in range(8):
            rows.append((100 + 20 * g + k, (c + rng.normal(size=8) * 0.06 * k).tolist()))
    rows += [(900 + i, [3.0] * 8) for i in range(30)] + [(None, [3.0] * 8), (-1, (rng.normal(size=8) * 1e-200).tolist()), (950, rng.normal(size=5000).tolist())]
    table = spark.createDataFrame([(v, e, 0, 1, "h") for v, e in rows], "vec_id long, embedding array<double>, label int, node int, h string")
    for block in (2048, 7):
        out = [tuple(r) for r in near_duplicates(table, block=block, cells=5).collect()]
        assert sorted(out, key=str) == brute(rows)


def test_null_and_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (7, [1.0, 0.01, 0.0]), (None, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (5, [1.0, 0.0, -1.0]), (3, [1.0, 0.01, -1.0]), (5, [-1.0, 0.0, -1.0])]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 1, 7, False), (7, 1, 7, True), (None, 1, 9, False), (9, 1, 9, True), (None, 0, None, False), (5, 1, 3, False), (3, 1, 3, True), (5, 0, 5, True)], key=str)


def test_clustered_vectors_are_pruned(spark):
    """50,000 vectors in 40 clusters and some outside: exact links, few pairs of blocks and rows compared."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 24))
    x = (np.where(np.arange(50_000)[:, None] % 50 == 3, rng.normal(size=(50_000, 24)), centre[np.arange(50_000) % 40]) + rng.normal(size=(50_000, 24)) * np.where(np.arange(50_000) % 7 == 0, 0.02, 0.25)[:, None]).astype(np.float32)
    report = {}
    table = spark.createDataFrame(embedding_dedup.pa.table({"vec_id": np.arange(50_000), "embedding": embedding_dedup.pa.array(list(x))}))
    out = near_duplicates(table, block=1024, report=report).toArrow()
    order = np.argsort(out.column("vec_id").to_numpy())
    u = normal(x.astype(float))
    links = np.zeros(50_000, int)
    for i in range(0, 50_000, 2000):
        links[i : i + 2000] = (u[i : i + 2000] @ u.T >= 0.9).sum(1) - 1
    assert (out.column("n_links").to_numpy()[order] == links).all() and links.sum() > 100_000
    assert report["block_pairs"] < 0.4 * report["all_block_pairs"] and report["compared"] < 0.3 * report["all"]
    assert report["all"] == 50_000 * 50_001 // 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def block(x, name="a", most=None, weight=None):
    r = {"block": name, "x": x.tobytes(), "width": x.shape[1], "weight": np.ones(len(x), np.int64) if weight is None else weight, "node": np.arange(len(x))}
    return Block(r | {"tree": embedding_dedup.pickle.dumps(tree(normal(x), 0.5, 3, most))}, "<f8")


def test_dual_traversal_is_exact():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1, 6)) + rng.normal(size=(40, 6)) * s for s in (0.01, 0.05, 0.2, 1)])
    weight = rng.integers(1, 5, len(x))
    for most in (None, 20, 0):
        a, b = block(x, most=most, weight=weight), block(x[:50] + 0.001, "b", most, weight[:50])
        true = normal(x) @ normal(x[:50] + 0.001).T >= 0.9
        got, seen = np.zeros_like(true), 0
        for rows, cols, link in dual(a, b, 0.9):
            got[np.ix_(rows, cols)] |= True if link is None else link
            seen += len(rows) * len(cols)
        assert (got == true).all() and seen <= true.size
        n, k, _, _, _ = linked(a, b, 0.9)
        want = np.concatenate([true @ weight[:50], true.T @ weight])
        assert sorted(k.tolist()) == sorted(want[want > 0].tolist())
        own = normal(x) @ normal(x).T >= 0.9
        np.fill_diagonal(own, False)
        n, k, _, _, _ = linked(a, a, 0.9)
        assert dict(zip(n.tolist(), k.tolist(), strict=True)) == {i: int(c) for i, c in enumerate(own @ weight) if c}


def test_tree_levels_nest_and_cover():
    x = normal(np.random.default_rng(0).normal(size=(200, 3)))
    levels = tree(x, 1.0, 4)
    for (a, na, ra), (b, nb, _) in zip(levels, levels[1:], strict=False):
        assert set(a) <= set(b) and all(na[b[n]] == na[i] for i, n in enumerate(nb))
        assert (np.linalg.norm(x - x[a[na]], axis=1) <= ra[na] + 1e-6).all()
    assert all(r.max() <= 1.0 / 2**i + 1e-5 for i, (_, _, r) in enumerate(levels))


def test_levels_without_near_points_are_not_built():
    x = normal(np.random.default_rng(0).normal(size=(1000, 64)))
    assert tree(x, 0.5, 3, 125) == [] and len(tree(np.repeat(x[:50], 20, 0), 0.5, 3, 125)) == 3


def test_open_pairs_in_strips_and_without_links(monkeypatch):
    rng = np.random.default_rng(8)
    x = normal(np.repeat(rng.normal(size=(12, 6)), 20, 0) + rng.normal(size=(240, 6)) * 0.05)
    grown, t = tree(x, 1.0, 4), np.sqrt(0.2)
    level, open_, whole = embedding_dedup.open_pairs(grown, x, grown, x, t)
    monkeypatch.setattr(embedding_dedup, "AT_ONCE", 7)
    again = embedding_dedup.open_pairs(grown, x, grown, x, t)
    assert again[0] == level and (again[1] == open_).all() and again[2] == whole and whole
    # all links are in pairs of nodes that are open or linked as a whole, or, without links, open
    node = grown[level][1]
    last, all_open, none = embedding_dedup.open_pairs(grown, x, grown, x, t, link=False)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert not none and last == len(grown) - 1 and all_open[grown[last][1][i], grown[last][1][j]].all() and not all_open.all()
    held = open_[np.ix_(node, node)] if level == last else np.zeros((240, 240), bool)
    for k, a, b in whole:
        held[np.ix_(grown[k][1] == a, grown[k][1] == b)] = True
    assert held[i, j].all()


def test_pairs_of_bins_are_those_of_their_cells():
    rng = np.random.default_rng(9)
    met, bins = rng.random((30, 30)) < 0.05, rng.integers(0, 9, 30)
    plain = {(min(bins[i], bins[j]), max(bins[i], bins[j])) for i in range(30) for j in range(30) if met[i, j]}
    assert set(zip(*embedding_dedup.bin_pairs_of(met, bins), strict=True)) == plain
