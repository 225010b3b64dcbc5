import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowdelta.llm import fill_in_middle as fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, text, n, "plain", None, None, text)
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return (doc_id, text, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, text, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def held(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transform(docs, **options)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = [plain(*r) for r in rows]
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == sorted(map(str, want))
    assert all(r["back"] == r["text"] for r in got)
    return want


def texts(seed, n, size):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t\x0b", "a", "bc", "é", "😀", "\x1f", "\x85", "\xa0", "<", ">", "P", "S", "M", "<P", "<S>"]
    weights = [9, 2, 2, 1, 9, 9, 3, 2, 1, 1, 1, 1, 1, 1, 1, 1, 0.5, 0.02]
    return ["".join(rng.choices(alphabet, weights, k=rng.randrange(size))) for _ in range(n)]


def test_against_a_plain_version(spark):
    rows = list(enumerate(["", None, " ", "a", " a", "a ", "\n\n", "<P>", "a <S", "<M> x", "x" * 200, " " * 130, "ab " * 64]))
    rows += [(i, t) for i, t in enumerate(texts(1, 400, 300), 100)] + [(None, "a b c d"), (None, None), (7, "a"), (7, "a")]
    want = held(spark, rows)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("piece, fan", [(7, 4), (130, 256)])
def test_long_texts_are_scanned_in_pieces(spark, piece, fan):
    # nearly all texts are long: pieces cut words, spaces and markers anywhere
    rows = [(i, t) for i, t in enumerate(texts(2, 120, 900))]
    rows += [(900 + k, " " * k + "word <P> " + "x" * 50) for k in range(20, 41)]
    rows += [(None, "some words " * 20), (None, "other words " * 20), (5, rows[5][1]), (1000, " " * 500), (1001, "x" * 500)]
    want = held(spark, rows, long_bytes=piece, fan_in=fan)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n long, form string")
    assert fim.transform(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c", 9, "x")], "doc_id long, text string, n long, output string")
    assert fim.transform(docs).first()["n"] == 3


def test_composition_is_that_of_the_whole():
    import numpy as np

    for t in texts(3, 50, 400):
        raw = np.frombuffer(t.encode(), np.uint8)
        cut = len(raw) // 3
        whole, left, right = (fim.Scan(d, np.array([0, len(d)])).function(0) for d in (raw, raw[:cut], raw[cut:]))
        for s in range(fim.STATES):
            mid = left[0][s]
            assert (whole[0][s], whole[1][s], whole[2][s]) == (right[0][mid], left[1][s] + right[1][mid], left[2][s] + right[2][mid])
