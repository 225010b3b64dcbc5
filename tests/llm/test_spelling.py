import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowdelta.llm import spelling


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def plain_variants(n):
    forms = {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n[w], len(near[w]), forms[w], forms[w] and n[forms[w]], root))
    return out


def noisy(rng, n, alphabet, longest):
    """Words with many near ones: random edits of a few."""
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(6, longest))) for _ in range(n // 8 + 1)]
    while len(pool) < n:
        w = list(rng.choice(pool))
        at = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(at, rng.choice(alphabet))
        elif at < len(w) and kind == 1:
            w[at] = rng.choice(alphabet)
        elif at < len(w):
            del w[at]
        pool.append("".join(w))
    return sorted({w for w in pool if len(w) >= 6})


def test_wavelet_tree_reports_all_points_of_rectangles():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(size)
        tree = spelling.WaveletTree(values)
        lo, hi = np.sort(rng.integers(0, size + 1, (2, 300)), axis=0)
        least, below = np.sort(rng.integers(0, size + 1, (2, 300)), axis=0)
        query, value = tree.report(lo, hi, least, below)
        want = {(q, int(v)) for q in range(300) for v in values[lo[q] : hi[q]] if least[q] <= v < below[q]}
        assert len(query) == len(want) and set(zip(query.tolist(), value.tolist())) == want


@pytest.mark.parametrize("group", [3, 8192])
def test_near_words_against_all_pairs(spark, group):
    rng = random.Random(group)
    words = noisy(rng, 500, "abé", 10) + noisy(rng, 200, "xyzÿ×", 20) + ["a" * k for k in range(6, 40)] + ["b" * 3000, "b" * 2999, "b" * 1500 + "c" + "b" * 1499]
    n = {w: rng.choice([5, 6, 30, 200, 1000, 1000]) for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(frame, group=group, rows=100).collect()}
    want = {}
    for w in n:
        if vs := [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)]:
            best = min(vs, key=lambda v: (-n[v], v))
            want[w] = (len(vs), n[best], best)
    assert got == want


def test_variants_of_documents(spark):
    rng = random.Random(5)
    words = noisy(rng, 120, "abcÀ", 9) + ["short", "Straße", "STRASSE", "naïveté", "x×y÷zz"]
    weights = [rng.choice([1, 3, 40]) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=60)) + rng.choice(["", "! 12,words-andmore_again", "Ünicode Ωmegaaaa"])) for i in range(300)]
    rows += [(None, "nullid " * 5 + "Nullid nullid"), (None, None), (1, ""), (1, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, word string")
    got = [tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    want = plain_variants(plain_counts(rows))
    assert len(got) == len(want) and set(got) == want
    assert sum(r[3] is not None for r in want) > 10


def test_chains_of_forms_end_in_one_root(spark):
    # each form has at least five times the count: ties go to the first by code points
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125, "zzzzzz": 6, "zzzzzé": 30, "zzzzza": 30}
    frame = spark.createDataFrame([(f"{w} " * k,) for w, k in n.items()], "text string").selectExpr("cast(null as long) doc_id", "text")
    got = {(r["word"], r["form"], r["root"]) for r in spelling.variants(frame, noise=1 << 40).collect()}
    chain = sorted(w for w in n if w[0] != "z")
    assert got == {(a, b, "bbbbbb") for a, b in zip(chain, chain[1:])} | {("bbbbbb", None, "bbbbbb"), ("zzzzzz", "zzzzza", "zzzzza"), ("zzzzza", None, "zzzzza"), ("zzzzzé", None, "zzzzzé")}


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "few words here"), (2, None)], "doc_id long, text string")).collect() == []
