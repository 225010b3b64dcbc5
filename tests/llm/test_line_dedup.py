import random
import time
from collections import defaultdict

from rowdelta.llm import line_dedup

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, chars=20, docs=3):
    low = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or len(held[key(x)]) < docs or low(d) == max(map(low, held[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(1)
    pool = [f"line number {i} " + "é" * (i % 9) for i in range(40)] + ["Ünïcode line is LONG enough 😀", "", "   "]
    rows = [(None, pool[12]), (None, pool[5]), (1, None), (2, ""), (3, "\n\n"), (4, "y" * 60_000 + "\n" + pool[7]), (5, (pool[7] + "\n") * 300)]
    for d in range(10, 120):
        lines = r.choices(pool, k=r.randint(1, 9)) + ["the one line that all documents share"]
        rows.append((d, "\n".join(r.choice([x.upper(), x, f"\t {x}\x0b\r"]) for x in lines)))
    rows += rows[8:14] + [(10, "other text of a known id\n" + pool[3])]
    docs = spark.createDataFrame([(d, t, 1, 2, "h") for d, t in rows], "doc_id long, text string, pos int, n int, text_hash string")
    for hot in (1000, 5):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        out = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
        assert sorted((tuple(x) for x in out), key=str) == brute(rows)


def test_bitmaps_name_the_kept_lines(spark):
    text = "\n".join(f"a line that is long enough {i}" for i in range(130))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "\n".join(text.split("\n")[70:71]))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(w) for w in r["keep"]] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert got == {1: [(1, ~(1 << 6))], 2: [(1, ~(1 << 6))]}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_clashing_names(spark):
    names = ["_id", "_hash", "_keep", "_lines", "_kept", "id", "hash", "row", "keep", "lines", "kept", "text_hash", "n_lines", "kept_text"]
    line = "a line that is long enough for this"
    docs = spark.createDataFrame([(d, line, *(f"{n}{d}" for n in names)) for d in range(4)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    for r in line_dedup.dedup_lines(docs).collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n not in ("n_lines", "kept_text"))
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == ((1, 0, line) if r["doc_id"] == 3 else (1, 1, ""))


def test_hot_lines_beyond_a_broadcast(spark, monkeypatch):
    rows = [(d, f"one line that a lot of documents share {d % 2}\nown line of this document number {d}") for d in range(600)]
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 50)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted((tuple(x) for x in out), key=str) == brute(rows)


def test_a_text_is_hashed_once_and_many_lines_take_no_quadratic_time(spark):
    """Half a million lines, all dropped but one document's, in seconds."""
    lines = [f"line number {i:07d} of a long text" for i in range(250_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines if i < 2 else lines[:200_000] + ["short"])) for i in range(3)], "doc_id long, text string")
    began = time.perf_counter()
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["kept_text"])) for r in line_dedup.dedup_lines(docs).collect()}
    assert time.perf_counter() - began < 60
    assert out == {0: (250_000, 200_000, 50_000 * 35 - 1), 1: (250_000, 200_000, 50_000 * 35 - 1), 2: (200_001, 0, 200_000 * 35 + 5)}


def test_bitmaps_of_far_apart_words(spark):
    filler = lambda d: [f"{d} {i}" for i in range(300)]
    shared = "a line that many documents share"
    rows = []
    for d in range(4):
        own = filler(d)
        for at in (5, 64, 190, 299)[: 1 + d % 4]:
            own[at] = shared
        rows.append((d, "\n".join(own)))
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if d == 3 or x != shared) for d, t in rows}
