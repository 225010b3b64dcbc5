import random

import pytest

import corpus_pipeline as cp
from rowdelta.llm import line_dedup, simhash

from .test_decontamination import brute as brute_overlaps
from .test_line_dedup import brute as brute_lines
from .test_simhash import brute_fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture
def rows():
    r = random.Random(0)
    a, b = ([f"{x}{y}{z}" for x in "kbt" for y in vowels for z in ("n", "rs", "")] for vowels in ("aeo", "üöä"))
    item = " ".join(r.choices(a, k=30))
    out = []
    for d in range(120):
        lang, words = ("xx", a) if d % 2 else ("yy", b)
        text = "\n".join(" ".join(r.choices(words, k=40)) for _ in range(3))
        out.append((d, text, lang, f"s{d % 3}"))
    out += [(200 + i, out[i][1] + " end", out[i][2], "s1") for i in range(10)]  # near copies
    out += [(300 + i, item, "xx", "s0") for i in range(2)] + [(310, "12 34 !", "xx", "s0"), (311, None, "yy", None), (312, "", None, "s2")]
    shared = "a line that a lot of the documents share koko"
    return [(d, f"{t}\n{shared}" if t and d % 4 == 0 else t, lang, s) for d, t, lang, s in out], item


def test_stages_against_plain_versions(spark, rows, tmp_path):
    docs, item = rows
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    now = table(spark, docs).cache()
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path)).cache()
        before, after = ([tuple(r) for r in df.select(*cp.COLUMNS).collect()] for df in (now, out))
        ids = {r[0] for r in after}
        if name == "language_id":
            assert {310, 311, 312}.isdisjoint(ids) and set(range(120)) <= ids and set(after) <= set(before)
        elif name == "line_dedup":
            want = {d: (kept, dropped) for d, _, dropped, kept in brute_lines([(r[0], r[1]) for r in before])}
            assert all(r[1] == want[r[0]][0] and r[4] == len(r[1]) for r in after) and len(after) == len(before)
            assert sum(d > 0 for _, d in want.values()) > 20
        elif name == "simhash_dedup":
            fp = {r[0]: brute_fp(r[1]) for r in before}
            # one of each group stays, the least
            gone = {d for d in fp for e in fp if e < d and (fp[d] ^ fp[e]).bit_count() <= 4}
            assert ids == set(fp) - gone and gone
        elif name == "decontamination":
            hit = {d: h > 0 and 20 * h >= n for d, n, h, _ in brute_overlaps([(r[0], r[1]) for r in before], [(1, item)])}
            assert ids == {r[0] for r in before if not hit[r[0]]} and any(hit.values())
        else:
            assert "copies" in out.columns and all(1 <= r["copies"] <= 3 for r in out.collect()) and ids <= {r[0] for r in before}
            for source in {r[3] for r in before}:
                own = [r for r in out.collect() if r["source"] == source]
                assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        if stage is not cp.STAGES[-1][1]:
            assert out.columns == list(cp.COLUMNS)
        now = out
    assert sorted(tuple(r) for r in cp.run(spark, str(tmp_path)).select("doc_id", "copies").collect()) == sorted(tuple(r) for r in now.select("doc_id", "copies").collect())


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, repeats, other columns and no rows at all."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, "some words here", None, None), (1, None, None, None), (1, "some words here", "xx", "s"), (1, "some words here", "xx", "s"), (2, "other text", "xx", "s")]
    for rows in (odd, []):
        docs = table(spark, rows).selectExpr("*", "1 AS component", "'c' AS keep", "2 AS grp")
        for _, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path)).collect()
            assert len(out) <= len(rows)


def test_repeated_rows_keep_the_targets(spark):
    """Equal rows of the mixing stage are one row with all their copies: a source's words stay near its target."""
    rows = [(1, "w " * 20, "xx", "a")] * 3 + [(2, "w " * 20, "xx", "a"), (3, "w " * 20, "xx", "b"), (None, "w " * 20, None, "b")]
    out = cp.mix_sources(spark, table(spark, rows), "").collect()
    assert len({(r["doc_id"], r["source"]) for r in out}) == len(out) <= 4
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20 and all(r["taken"] == r["copies"] * r["size"] for r in own)


def test_ties_of_near_copies_are_settled(spark):
    """Rows of one doc_id and text but other labels are one document, the same however the rows come."""
    rows = [(1, "some words that repeat", "yy", "b"), (1, "some words that repeat", "xx", "c"), (1, "some words that repeat", None, "a"), (2, "some words that repeat", "zz", "z")]
    outs = [[tuple(r) for r in cp.dedup_near_copies(spark, table(spark, x).repartition(n), "").collect()] for x, n in ((rows, 1), (rows[::-1], 4))]
    assert outs[0] == outs[1] == [(1, "some words that repeat", None, "a", 22)]


def test_documents_in_many_languages_stay(spark):
    """Texts that mix three of six languages fit none of them well, and stay; texts without letters go."""
    r = random.Random(1)
    words = [[f"{a}{b}{c}" for a in x for b in y for c in "nrs"] for x, y in (("kbt", "ae"), ("dfg", "ou"), ("lmp", "üö"), ("vwz", "iy"), ("hjq", "éè"), ("cxš", "ãñ"))]
    rows = [(d, " ".join(r.choices(words[d % 6], k=30)), f"l{d % 6}", "s") for d in range(600)]
    rows += [(1000 + d, " ".join(" ".join(r.choices(words[(d + k) % 6], k=20)) for k in range(3)), "l0", "s") for d in range(60)]
    rows += [(2000, "12 - 34 !", "l0", "s")]
    ids = {x["doc_id"] for x in cp.identify_language(spark, table(spark, rows), "").collect()}
    assert ids == {x[0] for x in rows} - {2000}


def test_line_stage_keeps_null_texts(spark, tmp_path):
    out = cp.dedup_lines(spark, table(spark, [(1, None, None, None)]), "").first()
    assert tuple(out) == (1, None, None, None, None)
    assert line_dedup.HOT and simhash.RADIUS
