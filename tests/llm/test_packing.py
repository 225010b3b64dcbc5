import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowdelta.llm import packing

public = pytest.importorskip("public_tokenizers")
FILE = public.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "model"):
        ids_of.model = Tokenizer.from_file(FILE)
    return [*ids_of.model.encode(text or "", add_special_tokens=False).ids, 1]


def one_by_one(counts, capacity):
    """Best-two-fit with single pieces and plain loops: sorted lengths of each sequence."""
    left = sorted(Counter(counts).elements(), reverse=True)
    out = []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        low = min(own)
        pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if low < a + b <= gap + low]
        if gap and pairs:
            total, a = max(pairs)
            own.remove(low)
            for x in (a, total - a):
                own.append(x)
                left.remove(x)
            left = sorted([*left, low], reverse=True)
        out.append(sorted(own))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=12))
def test_plan_is_packing_one_by_one(counts):
    made = [sorted(Counter(own).elements()) for repeats, own in packing.plan(counts, 24) for _ in range(repeats)]
    assert sorted(made) == one_by_one(counts, 24)


def test_two_take_the_place_of_the_shortest():
    # 60 + 30 leaves 10; without the 30, 20 + 20 fill it
    assert packing.plan({60: 1, 30: 1, 20: 2}, 100) == [(1, {60: 1, 20: 2}), (1, {30: 1})]


def test_plan_of_many_pieces_is_small():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5, 1.2, 200_000).astype(int), 1, 4096)
    counts = {int(k): int(v) * 1_000_000 for k, v in Counter(sizes.tolist()).items()}
    made = packing.plan(counts, 4096)
    assert len(made) < 2 * 4096
    used = sum(r for r, _ in made)
    least = -(-sum(k * v for k, v in counts.items()) // 4096)
    assert least <= used <= least * 1.001


def check(rows, packed, capacity):
    want = Counter()
    for doc_id, text in rows:
        ids = ids_of(text)
        for i in range(0, len(ids), capacity):
            own = ids[i : i + capacity]
            want[(doc_id, i // capacity, i, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    held = defaultdict(list)
    for r in packed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def test_against_whole_texts(spark):
    rng = random.Random(3)
    words = ["Straße", "é", "́x", "ΟΔΟΣ", "can't", "12ab", "<|endoftext|>", "x<|startoftext|>y", "日本語", "😀", "a\xa0b", "\x1cq", "\x85", "'s", "The", "of"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t\x0b", "  "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [*enumerate([*texts, "", None, " ", "word " * 500, "x" * 3000]), (None, "a b"), (None, "a b"), (None, None), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    packed = packing.pack(docs, FILE, capacity=64).collect()
    held = check(rows, packed, 64)
    made = [sorted(n for _, n in own) for own in held.values()]
    assert sorted(made) == one_by_one(Counter(r["length"] for r in packed), 64)
    by_id = {r["sequence_id"]: r for r in packing.sequences(spark.createDataFrame(packed)).collect()}
    for r in packed:
        own = by_id[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert own == r["ids"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]


def test_hot_lengths_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "FEWEST", 10)
    rows = [(i, "same words here") for i in range(700)] + [(1, "again")] * 300 + [(None, f"w{i} of two") for i in range(150)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), FILE, with_ids=False).collect()
    held = check(rows, packed, 4096)
    assert len(held) == -(-sum(r["length"] for r in packed) // 4096)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


LETTERS = "abzABZsStTmMdDlLvVrReE019'\"!-.<>|_ßÀÖ×Øàöø÷ÿªº²¼İĀ́ΣςΩ日😀\xa0\x1c\x7f\x80"


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS), min_size=1, max_size=9), max_size=6))
def test_pieces_of_words_are_those_of_the_tokenizer(words):
    text = " ".join(words)
    ids, offsets = packing.encoder(FILE)(pa.array([text]))
    assert [*ids.tolist(), 1] == ids_of(text)


def test_words_are_split_by_the_known_pattern_only():
    seen = []
    own = packing.Encoder(lambda words: (seen.extend(words), [[0]] * len(words))[1], True, ["<|endoftext|>"])
    own(pa.array(["Can't,x2'sANTA's ''s 'RE'vex", "<|endoftext|>A <|X É×A ÉA"]))
    assert sorted(seen) == sorted({"can", "'t", ",", "x", "2", "'s", "anta", "''", "s", "'re", "'ve", "<|endoftext|>A", "<|X", "É×A", "éa"})
    assert packing.encoder(FILE).split
    assert not packing.encoder(public.path("byte_bpe_50k.json")).split


def test_words_that_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 2)
    encode = packing.Encoder(lambda words: ([len(w)] * len(w) for w in words))
    for texts in (["a bb", None, ""], ["ccc a"], ["bb bb a\n"]):
        ids, offsets = encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, offsets, offsets[1:]):
            assert ids[a:b].tolist() == [len(w) for w in (t or "").split() for _ in w]
