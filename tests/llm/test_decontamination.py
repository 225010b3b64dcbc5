import random
import re

import pytest

from rowdelta.llm import decontamination


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, n=13):
    win = {}
    for i, t in items:
        w = words(t)
        for p in range(max(len(w) - n, 0) + 1 if w else 0):
            win.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in win}:
            for p in range(len(w) - size + 1):
                if found := win.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [3, 300])
def test_against_brute_force(spark, vocabulary, monkeypatch):
    r = random.Random(vocabulary)
    word = [f"w{i}é" if i % 4 == 0 else f"W{i}" for i in range(vocabulary)]
    items = [(i, " ".join(r.choices(word, k=r.choice([1, 2, 4, 12, 13, 14, 40])))) for i in range(25)] + [(None, " ".join(word[:20])), (90, None), (91, ""), (92, "?!"), (3, " ".join(r.choices(word, k=15)))]
    items += items[:2]
    docs = [(None, "a b"), (1, None), (2, ""), (3, "... \n"), (4, "z" * 40_000)]
    for d in range(10, 90):
        w = r.choices(word, k=r.randint(1, 60))
        if d % 2:
            w[len(w) // 2 : len(w) // 2] = words(r.choice(items)[1])[r.randint(0, 3) :]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w)))
    docs += docs[6:9]
    a = spark.createDataFrame([(d, t, "n", 1) for d, t in docs], "doc_id long, text string, name string, n int")
    b = spark.createDataFrame([(d, t, 5) for d, t in items], "item_id long, text string, k int")
    for rows, tokens in ((200_000, 0), (0, 4_000_000), (0, 0)):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontamination, "MOST_TOKENS", tokens)
        got = [(x[0], x[2], x[3], list(x[4])) for x in decontamination.overlaps(a, b).collect()]
        assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    one = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, item_id long")
    assert decontamination.overlaps(none, one).count() == 0
    assert [tuple(r)[2:4] for r in decontamination.overlaps(one, none).collect()] == [(2, 0)]


def test_very_many_prefixes_leave_documents_unshuffled(spark, monkeypatch):
    """Over 200,000 windows: shingles are filtered by broadcast tokens where they are, only candidates move."""
    text = "concat_ws(' ', transform(sequence(1, 13), i -> concat('w', hex(xxhash64(x, i)))))"
    items = spark.range(210_000).selectExpr("id AS item_id", "id AS x").selectExpr("item_id", f"{text} AS text")
    docs = spark.range(200).selectExpr("id AS doc_id", "if(id % 4 = 0, id * 1000, id + 10000000) AS x").selectExpr("doc_id", f"concat('before it ', {text}, ' after it') AS text")
    seen, plain = [], decontamination._candidates
    monkeypatch.setattr(decontamination, "_candidates", lambda a, b: seen.append(plain(a, b)) or seen[0])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontamination.overlaps(docs, items).collect()}
    assert got == {d: (17, 13, [str(d * 1000)]) if d % 4 == 0 else (17, 0, []) for d in range(200)}
    lines = seen[0]._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    above = [x for x in lines[:at] if "Exchange" in x or "LeftSemi" in x]
    assert "BroadcastHashJoin" in above[-1] and "LeftSemi" in above[-1]
