import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowdelta.llm import brown_lm


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", text), None]


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def corpus(n=300, seed=0):
    rng = np.random.default_rng(seed)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"V{i}é" for i in range(40)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(int(rng.integers(1, 40))):
            words += [nouns[int(rng.zipf(1.6)) % 40], verbs[int(rng.zipf(1.6)) % 40]]
        rows.append((d, " ".join([*words, f"rare{d // 3}"])))
    return rows


def test_base_score_and_counts(spark):
    rows = [*corpus(), (None, "n1 V2é"), (1000, None), (1001, ""), (1002, "x " * 30_000), (1003, "never seen before")]
    rows += rows[:5]
    c = Counter(t for d, x in rows if not is_held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, is_held(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for d, x in rows), key=str)
    docs = spark.createDataFrame([(d, x, 1, "r") for d, x in rows], "doc_id long, text string, key long, rare string")
    for frequent in (1 << 17, 30, 0):
        out = brown_lm.score(docs, frequent=frequent, clustered=20, classes=4).collect()
        assert sorted(((*r[:5], round(r["base_score"], 6)) for r in out), key=str) == want
        assert all(r["score"] < 0 and r["perplexity"] > 1 for r in out)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = corpus(1500)
    out = brown_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), clustered=64, classes=8).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.05 * abs(sum(r["base_score"] for r in out))


def test_model_is_a_distribution():
    """Emissions and transitions each sum to one, the rare class with a place for one unknown word."""
    # places 0, 1 in class 0, 2 in class 1, END in class 2; the rare class 3 has five words seen once
    counts, of = np.array([30, 10, 20, 10]), np.array([0, 0, 1, 2])
    m = np.outer([40, 20, 10, 5], [40, 20, 10, 5]) / 75
    model = brown_lm.Model(counts, of, m, 75, 9)
    assert np.allclose((10**model.transition).sum(1), 1)
    assert np.allclose(np.bincount(of, 10**model.emission), 1)
    rare = np.array([2, 2, 2, 2, 2, 1]) / 10**model.rare_log
    assert abs(rare.sum() - 1) < 1e-9


def test_scores_against_brute_force(spark):
    """A scorer of its own, from texts and each word's class alone: class bigrams, back-off and emissions counted again."""
    rows = [*corpus(), (None, "n1 V2é"), (1000, None), (1001, ""), (1002, "x " * 3000), (1003, "never seen before"), (1004, "n1 rare5 n2 rare6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false) held_out", "coalesce(text, '') t").drop("text").withColumnRenamed("t", "text")
    name = {int(k): w for w in {w for _, x in rows for w in tokens(x) if w} for k in brown_lm.tokens_of(brown_lm.pa.array([w]))[0][:1]}
    for frequent in (1 << 17, 30, 0):
        t = brown_lm.train(docs, frequent=frequent, clustered=20, classes=4)
        of = {name[int(k)]: int(c) for k, c in zip(t.keys, t.model.of, strict=False)} | {name[r["key"]]: r["of"] for r in t.others.collect()}
        c = Counter(x for d, text in rows if not is_held(d) for x in tokens(text))
        # 4 classes, the end's and that of words seen once or never
        own = lambda x: 4 if x is None else of.get(x, 5)  # noqa: B023, E731
        assert all((own(w) < 4) == (n > 1) for w, n in c.items() if w)
        mass, m = Counter(), Counter()
        for d, text in rows:
            if not is_held(d):
                seq = [4, *map(own, tokens(text))]
                mass.update(seq[1:])
                m.update(zip(seq, seq[1:], strict=False))
        follow, n = Counter(), sum(mass.values())
        for (a, _), k in m.items():
            follow[a] += k

        def score(text):
            out, before = 0.0, 4
            for x in tokens(text):
                k = own(x)  # noqa: B023
                emission = (c[x] + 1) / (2 * mass[5] + 1) if k == 5 else c[x] / mass[k]  # noqa: B023
                out += math.log10((m[before, k] + 10 * (mass[k] + 1) / (n + 6)) / (follow[before] + 10) * emission)  # noqa: B023
                before = k
            return round(out, 6)

        got = brown_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent, clustered=20, classes=4).collect()
        assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=str) == sorted(((d, score(x)) for d, x in rows), key=str)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    kind = np.arange(30) % 2
    pairs = rng.poisson(np.where(kind[:, None] != kind[None, :], 20, 0.1))
    shuffled = rng.permutation(30)
    of = brown_lm.exchange(np.pad(pairs[np.ix_(shuffled, shuffled)], (0, 1)), 30, 2)
    assert of[30] == 2 and len({(a, b) for a, b in zip(of[:30].tolist(), kind[shuffled].tolist(), strict=True)}) == 2


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(rng.gamma(0.3, 4, (24, 24)))

    def likelihood(of):
        h = np.eye(of.max() + 1)[of]
        m = h.T @ pairs @ h
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    start = np.concatenate([np.arange(20) % 5, 5 + np.arange(4)])
    last = likelihood(start)
    for sweeps in (1, 2, 6):
        now = likelihood(brown_lm.exchange(pairs, 20, 5, sweeps))
        assert now >= last - 1e-6
        last = now


def test_empty_and_untrained(spark):
    assert brown_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(d for d in range(100) if is_held(d))
    r = brown_lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_best_class_is_that_of_greatest_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(rng.gamma(0.3, 4, (26, 26)))
    more = pairs.sum(1) - pairs.sum(0)  # as many bigrams from a unit as to it
    pairs[25] += np.maximum(more, 0)
    pairs[:, 25] += np.maximum(-more, 0)
    of = np.append(np.arange(24) % 6, [6, 7])
    of[20:24] = 7
    hot = np.eye(8, dtype=int)[of]
    out, in_ = (pairs - np.diag(np.diag(pairs))) @ hot, (pairs - np.diag(np.diag(pairs))).T @ hot
    stat = np.concatenate([out, in_, np.diag(pairs)[:, None]], 1)
    got = brown_lm.best_classes(stat[:24], of[:24], hot.T @ pairs @ hot, 6)

    def with_class(w, k):
        h = np.eye(8, dtype=int)[np.where(np.arange(26) == w, k, of)]
        return brown_lm.likelihood(h.T @ pairs @ h)

    assert got.tolist() == [int(np.argmax([with_class(w, k) for k in range(6)])) for w in range(24)]


def test_all_words_seen_twice_are_clustered(spark):
    """Rare words get classes by their context, and the same whether broadcast or joined."""
    rng = np.random.default_rng(2)
    rows = []
    for d in range(600):
        x = []
        for _ in range(20):
            x += [f"n{rng.zipf(1.3) % 5 if rng.random() < 0.7 else rng.integers(5, 400)}", f"v{rng.zipf(1.3) % 5 if rng.random() < 0.7 else rng.integers(5, 400)}"]
        rows.append((d, " ".join([*x, *(["n1 n1"] * (d % 5 == 0))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    others = brown_lm.train(docs.withColumn("held_out", brown_lm.held_out()), frequent=30, clustered=10, classes=2).others.where("c > 1")
    name = {int(k): w for w in {w for _, t in rows for w in t.split()} for k in brown_lm.tokens_of(brown_lm.pa.array([w]))[0][:1]}
    found = Counter((name[r["key"]][0], r["of"]) for r in others.collect())
    assert sum(found.values()) > 600 and max(found["n", 0], found["n", 1]) + max(found["v", 0], found["v", 1]) > 0.95 * sum(found.values())
    scores = [sorted((r["doc_id"], round(r["score"], 6)) for r in brown_lm.score(docs, frequent=f, clustered=10, classes=2).collect()) for f in (1 << 17, 30)]
    assert scores[0] == scores[1]


def test_words_that_collide_in_polynomials_are_told_apart(spark):
    from tests.llm.test_substring_dedup import thue_morse

    a, b = thue_morse()
    seen = next(i for i in range(99) if not is_held(i))
    held = next(i for i in range(99) if is_held(i))
    docs = spark.createDataFrame([(seen, f"{a} word word"), (held, f"{b} word")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in brown_lm.score(docs).collect()} == {seen: 4, held: 2}


@pytest.mark.parametrize("clustered, classes", [(4, 8), (64, 8), (10, 2)])
def test_what_is_broadcast_changes_no_score(spark, clustered, classes):
    """Neither with fewer seeds than classes nor with a bound below the number of seeds, and reruns agree."""
    rng = np.random.default_rng(3)
    rows = [(d, " ".join(f"w{rng.zipf(1.4) % 300}" for _ in range(40))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in brown_lm.score(docs.repartition(n), frequent=f, clustered=clustered, classes=classes).collect()} for f, n in ((1 << 17, 2), (40, 3), (1, 2), (1 << 17, 5))]
    for other in scores[1:]:
        assert max(abs(other[d] - scores[0][d]) for d in other) < 1e-9
