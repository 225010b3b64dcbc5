import hashlib
import re

import numpy as np

from rowdelta.llm.substring_dedup import removals


def brute(rows, n=20):
    docs = sorted([(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows], key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - n + 1):
            s = tuple(w[i : i + n])
            if s in seen:
                gone |= set(range(i, i + n))
            seen.add(s)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    word = [f"w{i}" + "é" * (i % 3) for i in range(500)]
    passage = " ".join(rng.choice(word, 50))
    rows = [(None, passage), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 45), (5, "a " * 19), (6, passage), (7, passage + " " + passage), (8, "x" * 100_000)]
    for d in range(10, 90):
        text = " ".join(rng.choice(word, rng.integers(1, 120)))
        rows.append((d, f"{text}\n{passage}\x0b{text}" if d % 3 == 0 else text.upper()))
    rows += [(d + 500, t) for d, t in rows[20:30]]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, chunk int, bucket string")
    out = removals(docs, with_text=True, chunk_bytes=1000)
    got = out.collect()
    assert sorted((tuple(r[:4]) for r in got), key=str) == brute(rows)
    for r in got:
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_repeated_rows_of_one_id(spark):
    text = " ".join(map(str, range(30)))
    got = [tuple(r[:3]) for r in removals(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 30, 0), (1, 30, 30)]


def test_empty_table(spark):
    assert removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_null_and_repeated_ids(spark):
    """A third of the rows have no id and others repeat one: they spread over chunks, and each text keeps one copy."""
    rng = np.random.default_rng(1)
    word = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(word, 40)) for _ in range(60)]
    rows = [(None, texts[i % 20]) for i in range(100)] + [(7, texts[20 + i % 20]) for i in range(100)] + [(100 + i, texts[i % 60]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    outs = [sorted((tuple(r[:4]) for r in removals(docs.repartition(n), chunk_bytes=500).collect()), key=str) for n in (5, 11)]
    assert outs[0] == outs[1] and len(outs[0]) == 300
    kept = lambda d: sorted(r[2] for r in outs[0] if r[0] == d)
    # the first of the rows of a text keeps it; ids over 100 keep those that no smaller id holds
    assert kept(None) == kept(7) == [0] * 20 + [40] * 80
    assert sum(r[2] == 0 for r in outs[0] if (r[0] or 0) >= 100) == 20


def thue_morse(levels=10):
    """Two words of 1,024 letters whose hashes by any polynomial modulo 2**64 with an odd base are equal."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_in_polynomials_are_told_apart(spark):
    a, b = thue_morse()
    words = [f"w{i}" for i in range(10)]
    rows = [(1, " ".join([*words, a, *words])), (2, " ".join([*words, b, *words])), (3, " ".join([*words, a, *words]))]
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == (0, hashlib.sha256(rows[1][1].encode()).hexdigest()) and got[3][0] == 21


def test_word_hashes():
    import pyarrow as pa

    from rowdelta.llm.tokens import Words

    a, b = thue_morse()
    texts = ["", "x", "xx", "x x", "abcdefgh", "abcdefghi", "abcdefgh\0", "é" * 200, a, b, a[:256], b[:256], a[:257], a[:8], b[:8], "\0", "\0\0"]
    words = Words(pa.array([" ".join(texts)]))
    h = words.hashes().tolist()
    each = [w.encode() for w in " ".join(texts).split()]
    assert [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)] == each
    assert len(set(h)) == len(set(each)) and all((x == y) == (u == v) for x, u in zip(h, each) for y, v in zip(h, each))
