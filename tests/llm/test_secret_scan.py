import bisect
import hashlib
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from rowdelta.llm import secret_scan

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 1, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def mixed(text, own):
    found = [(m.start(), 4, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text or "")]
    return [s for s in found if all(re.search(c, s[3]) for c in ("[0-9]", "[a-z]", "[A-Z]")) and not any(b[0] < s[2] and s[0] < b[2] for b in own)]


def test_against_brute_force(spark):
    r = random.Random(3)
    bits = ["password = 'hunter22'", "PassWd:abcdef", "TOKEN=token:abcdefgh", "secret==abc", "api_key\": \"Zz9+/_.=-\"", "apikey :  short", "AKIA" + "Q" * 16, "AKIAAKIA" + "0" * 11, "é😀", "deadbeef" * 3, "deadbee" * 3, "Abcdefghij0123456789XYZ", "Shared0Example1Token2Value", "\n", "password", "=", "token = Kabcdefg", "x" * 30]
    rows = [(1, None, "a"), (2, "", None), (None, "token=abcdefg", "b"), (3, "password=" + "A1b" * 20_000, "c")]
    for d in range(10, 160):
        text = r.choice([" ", "", " "]).join(r.choices(bits, k=r.randint(1, 12)))
        rows.append((d, text + (f" Own{d}abcdefghijk0123456789" if d % 5 == 0 else ""), f"s{d % 4}"))
    rows += rows[:6]
    rows += [(400 + d, "Hot1Value2Of3One4Owner5Zz", "only") for d in range(8)] + [(None, "Hot1Value2Of3One4Owner5Zz", "only")] * 3 + [(500, "Rep1eated2Rows3Of4One5Doc", "only")] * 9
    owners, homes, copies = defaultdict(set), defaultdict(set), {}
    for d, t, s in rows:
        own = base(t)
        copies[t] = own, mixed(t, own)
        for x in own + copies[t][1]:
            owners[x[3]].add(s)
            homes[x[3]].add((s, d))
    owned = lambda x: len(owners[x[3]]) < 3 and len(homes[x[3]]) < 9
    expected = []
    for d, t, _ in rows:
        own, more = copies[t]
        added = [x for x in more if owned(x)]
        name = lambda xs: ",".join(f"{secret_scan.KINDS[k - 1]}:{a}:{b}" for a, k, b, _ in sorted(xs))
        few = sum(map(owned, own + more))
        expected.append((d, name(own), name(own + added), few, len(own + more) - few, *(max((len(h[x[3]]) for x in own + more), default=0) for h in (owners, homes))))
    docs = spark.createDataFrame([(d, t, s, "u", 1) for d, t, s in rows], "doc_id long, text string, source string, owner string, base int")
    out = secret_scan.scan(docs, copied_repositories=9)
    out = out.select("doc_id", secret_scan.shown(F.col("base")), secret_scan.shown(F.array_sort(F.concat("base", "added"))), "n_owned", "n_copied", "most_owners", "most_repositories")
    assert sorted((tuple(x) for x in out.collect()), key=str) == sorted(expected, key=str)
    assert any(e[2] != e[1] for e in expected) and any(e[4] for e in expected)


def test_empty_table(spark):
    assert secret_scan.scan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_hash_of_nothing(spark):
    out = secret_scan.scan(spark.createDataFrame([(1, "no", "a")], "doc_id long, text string, source string")).select(F.sha2(secret_scan.shown(F.col("base")), 256)).first()[0]
    assert out == hashlib.sha256(b"").hexdigest()


def test_texts_of_very_many_matches(spark):
    """Places are right across runs of matches, and 30,000 of them take no quadratic time."""
    text = " é".join(f"{i:024x}" for i in range(30_000))
    base = secret_scan.scan(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()["base"]
    assert len(base) == 30_000 and all(text[s["start"] : s["end"]] == f"{i:024x}" for i, s in enumerate(base))


def test_mixed_tokens_between_very_many_assignments(spark):
    """Each token overlaps, follows or precedes assignments: spans agree with plain loops, and 1 MB takes seconds."""
    parts = [f"token={i:08x}Zz {'aB3' * 8}{i:05d} " if i % 3 else f"{'Cd4' * 7}{i:05d} secret: {'eF5' * 8}{i:06d} " for i in range(21_000)]
    text = "".join(parts)
    assert len(text) > 1_000_000
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    began = time.perf_counter()
    found = secret_scan.scan(docs).first()
    assert time.perf_counter() - began < 30
    own = base(text)
    assert [(s["start"], s["rank"], s["end"]) for s in found["base"]] == sorted(x[:3] for x in own)
    assign = sorted((a, b) for a, k, b, _ in own if k == 1)
    starts = [a for a, _ in assign]
    want = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
        v = m.group()
        at = bisect.bisect_left(starts, m.end())
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not (at and assign[at - 1][1] > m.start()):
            want.append(m.span())
    assert [(s["start"], s["end"]) for s in found["added"]] == want and len(want) > 20_000
