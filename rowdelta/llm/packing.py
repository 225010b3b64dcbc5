"""Packing of documents into token sequences by best-two-fit.

A sequence is filled greedily, the longest piece that fits first. Its shortest piece then gives way to two unpacked
ones if some two fill the gap, widened by that piece, more tightly. What decides is only how many pieces of each
length are unpacked, and lengths are bounded by the capacity, so sequences are planned on these counts: a pattern of
lengths is repeated while the counts last, as packing one sequence after the other would. Pieces are numbered within
their length by Spark, and a piece's number says which sequence of which pattern it fills.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.workers import ship

from .common import parts, stored, text_key
from .tokens import IN_WORD, slices, utf8

END = 1
#: Encoded pieces of words that a worker keeps.
KEPT = 400_000
#: Pieces of one length that a task numbers: between these, by how many there are.
FEWEST, MOST = 500, 100_000


#: The pattern by which some tokenizers split lower-cased words into pieces that do not see each other.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[~IN_WORD] = _SPACE
_KIND[ord("0") : ord("9") + 1] = _DIGIT
for _a, _z in ("az", "AZ"):
    _KIND[ord(_a) : ord(_z) + 1] = _LETTER


def _pieces(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of UTF-8 texts, lower-cased, and where pieces by ``PATTERN`` start; space is in none.

    A word of other characters than printable ASCII and Latin-1 letters, or with the first two bytes of one of
    ``whole``, is one piece as it is: the tokenizer splits it."""
    n = len(data)
    kind = _KIND[data]
    # U+00C0 to U+00FF are C3 80 to C3 BF, letters but for U+00D7 and U+00F7
    second = np.zeros(n, bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[second] = _LETTER
    kind[:-1][second[1:]] = _LETTER
    space = kind == _SPACE
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    begins[1:] |= space[:-1]
    begins &= ~space
    word = np.cumsum(begins) - 1
    odd = kind == _ODD
    for token in whole:
        odd[:-1] |= (data[:-1] == token[0]) & (data[1:] == token[1])
    odd_word = np.zeros(word[-1] + 1 if n else 0, bool)
    odd_word[word[odd & ~space]] = True
    plain = ~space & ~odd_word[word] if len(odd_word) else np.zeros(n, bool)
    lower = data.copy()
    lower[plain & (data >= 65) & (data <= 90)] += 32
    lower[plain & second & (data <= 0x9E)] += 32
    start = begins.copy()
    start[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    # an apostrophe that starts a piece takes the letters of a contraction with it
    quote = np.flatnonzero(start & plain & (data == ord("'")))
    last = np.concatenate([np.flatnonzero(begins), [n]])[1:]  # where the next word begins
    for letters in CONTRACTIONS:
        size = len(letters) + 1
        at = quote[quote + size <= last[word[quote]]]
        for k, letter in enumerate(letters):
            at = at[lower[at + 1 + k] == letter]
        start[at + 1] = False
        after = at[at + size < n] + size
        start[after] |= ~space[after]
    return lower, start & ~space


class Encoder:
    """Token ids of whole columns of texts: each distinct piece of a batch is encoded once, and none that was seen.

    Right for tokenizers that split texts at ``[\\x20\\x09-\\x0D]`` and drop these, so that words do not see each other.
    ``split`` says that they lower-case and split words by ``PATTERN`` too; ``whole`` are tokens of their own."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], split: bool = False, whole: Iterable[str] = ()):
        self.encode, self.split = encode, split
        self.whole = [t.encode() for t in whole]
        self.kept: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and len + 1 offsets. Null is empty."""
        data, offsets = utf8(texts)
        inside = IN_WORD[data]
        if self.split:
            data, start = _pieces(data, offsets, self.whole)
        else:
            start = np.zeros(len(data), bool)
            start[offsets[:-1][offsets[:-1] < len(data)]] = True
            start[1:] |= ~inside[:-1]
            start &= inside
        # pieces are all that is not space, in order
        upto = np.concatenate([[0], np.cumsum(inside)])
        first = np.flatnonzero(start)
        edges = np.concatenate([upto[first], upto[-1:]])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
        raw = self._encoded(pieces.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(raw), np.uint32)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        place = np.cumsum(size) - size
        at = pieces.indices.to_numpy().astype(np.int64)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(place[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(first, offsets)]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        new = [p for p in pieces if p not in kept]
        for p, ids in zip(new, self.encode([p.decode() for p in new]), strict=True):
            kept[p] = np.array(ids, np.uint32).tobytes()
        return [kept[p] for p in pieces]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: its own if that is printable, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
#: Pieces that normalisation leaves as they are.
PLAIN = re.compile("[!-@[-~ß-öø-ÿ]+")
_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The process's encoder of a tokenizer file.

    Where its steps are known, pieces go to the merges themselves; other ones through all steps."""
    if tokenizer not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer)
        steps = json.loads(whole.to_str())
        tokens = [t["content"] for t in steps["added_tokens"]]
        before = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = any(p.get("pattern") == {"Regex": PATTERN} for p in before)
        split &= any(n["type"] == "Lowercase" for n in (steps["normalizer"] or {}).get("normalizers", []))
        direct = split and [(p["type"], p.get("add_prefix_space")) for p in before] == [("Split", None), ("ByteLevel", False)] and steps["model"]["type"] == "BPE"
        model = whole.model

        def encode(pieces: list[str]) -> Iterator[list[int]]:
            plain = [direct and PLAIN.fullmatch(p) is not None and not any(t[:2] in p for t in tokens) for p in pieces]
            others = iter(whole.encode_batch_fast([p for p, easy in zip(pieces, plain, strict=True) if not easy], add_special_tokens=False))
            for p, easy in zip(pieces, plain, strict=True):
                if easy:
                    yield [t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS))]
                else:
                    yield next(others).ids

        _ENCODERS[tokenizer] = Encoder(encode, split, tokens)
    return _ENCODERS[tokenizer]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """doc_id, text_hash, piece, start, length, ids_crc32 and, on request, ids of each piece of each row of ``docs``.

    A document is its ids by the file ``tokenizer``, which has to be there for executors, then id 1. One of over
    ``capacity`` ids is cut into pieces of as many, the last of which may be shorter. Texts are encoded piece by piece,
    see :class:`Encoder`. A null text is empty: its document is the id 1."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = encode(batch.column("text"))
                ids = np.insert(ids, offsets[1:], END).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                n = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(len(batch)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                lo = offsets[row] + start
                hi = np.minimum(lo + capacity, offsets[row + 1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                made = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_hash")]
                made += [pa.array(piece, pa.int32()), pa.array(start), pa.array(hi - lo), pa.array(crc, pa.int64())]
                if with_ids:
                    # pieces of a batch cover its ids without gaps
                    made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([lo, hi[-1:]]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, [f.name for f in schema])

    fields = [("doc_id", "bigint"), ("text_hash", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    schema = T.StructType([T.StructField(n, T.IntegerType() if kind == "int" else T.LongType()) for n, kind in fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_hash")).mapInArrow(per_batch, schema)


def _fill(count: np.ndarray, capacity: int) -> tuple[Counter, Counter]:
    """One sequence from ``count`` unpacked pieces of each length: how many of each it takes, and how many had to be
    there for it to be made."""
    sizes = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(count > 0, sizes, 0))  # the greatest unpacked length up to each
    own, gap, top = Counter(), capacity, capacity
    while size := int(below[min(gap, top)]):
        own[size] = min(int(count[size]), gap // size)
        gap -= size * own[size]
        top = size - 1
    if not gap:
        return own, own
    left = count.copy()
    for size, n in own.items():
        left[size] -= n
    below = np.maximum.accumulate(np.where(left > 0, sizes, 0))
    shortest = min(own)
    wide = gap + shortest
    longer = np.flatnonzero(left[:wide] > 0)
    if not len(longer):
        return own, own
    # the longer of two, and the greatest that fits beside it
    shorter = below[np.minimum(longer - (left[longer] < 2), wide - longer)]
    both = np.where(shorter > 0, longer + shorter, 0)
    best = len(both) - 1 - int(both[::-1].argmax())  # of equal sums the one with the longest piece
    if both[best] <= shortest:
        return own, own
    there = own + Counter([int(longer[best]), int(shorter[best])])
    return there - Counter([shortest]), there


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, lengths with how many of each) of all sequences, in order; ``counts`` are pieces of each length."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} tokens does not fit {capacity}")
        count[size] = n
    out = []
    while count.any():
        own, there = _fill(count, capacity)
        repeats = min((int(count[s]) - there[s]) // n + 1 for s, n in own.items())
        for size, n in own.items():
            count[size] -= n * repeats
        out.append((repeats, dict(own)))
    return out


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces of that length in a sequence, offset), sorted."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for repeats, own in patterns:
        offset = 0
        for size in sorted(own, reverse=True):
            rows.append((size, taken[size], sequence, own[size], offset))
            taken[size] += own[size] * repeats
            offset += own[size] * size
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The rows of ``pieces``, which have a ``length`` of 1 to ``capacity``, with sequence_id and offset.

    Sequences hold at most ``capacity`` tokens and are filled from offset 0 without gaps. The driver holds one count a
    length and the patterns made of them, whose number depends on ``capacity`` alone. Equal rows are kept, each with a
    place of its own. No rows, no result.
    """
    names = pieces.columns
    spark = ship(pieces.sparkSession)
    # equal rows of a task are one with a count, so that no window holds them all
    held = stored(pieces.groupBy(F.spark_partition_id().alias("_task"), *[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_copies")), "pieces")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("_copies").alias("n")).collect()}
    slots = _slots(plan(counts, capacity))
    dealt = {size: -(-n // min(max(n // (4 * parts(spark)), FEWEST), MOST)) for size, n in counts.items()}
    many = F.create_map(*[F.lit(x).cast("long") for size, n in dealt.items() if n > 1 for x in (size, n)]) if max(dealt.values(), default=1) > 1 else F.create_map().cast("map<bigint,bigint>")
    own = [F.col(f"`{c}`") for c in names]
    rows = held.withColumn("_deal", F.pmod(F.xxhash64("_task", *own), F.coalesce(F.try_element_at(many, F.col("length").cast("long")), F.lit(1))))
    totals = rows.groupBy("length", "_deal").agg(F.sum("_copies").alias("_n"))
    starts = totals.select("length", "_deal", (F.sum("_n").over(Window.partitionBy("length").orderBy("_deal")) - F.col("_n")).alias("_start"))
    within = F.sum("_copies").over(Window.partitionBy("length", "_deal").orderBy("_task", *own).rowsBetween(Window.unboundedPreceding, -1))
    ranked = rows.withColumn("_before", F.coalesce(within, F.lit(0))).join(starts, ["length", "_deal"])
    first = F.col("_start") + F.col("_before")
    numbered = ranked.select(*own, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("_number"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number, sequence, each, offset = slots.T
        for batch in batches:
            length, k = batch.column("length").to_numpy().astype(np.int64), batch.column("_number").to_numpy()
            at = np.zeros(len(length), np.int64)
            for s in np.unique(length):
                lo, hi = np.searchsorted(size, [s, s + 1])
                own = length == s
                at[own] = lo + np.searchsorted(number[lo:hi], k[own], "right") - 1
            turn = k - number[at]
            made = [pa.array(sequence[at] + turn // each[at]), pa.array(offset[at] + turn % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "sequence_id", "offset"])

    kind = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(per_batch, kind)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of ``docs``, see :func:`tokenize`, with their places, see :func:`place`.

    Null ids and repeated rows are documents like others; other columns of ``docs`` are left out."""
    return place(tokenize(docs, tokenizer, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the doc_ids of its pieces in order, of pieces with ids. A sequence is at most ``capacity`` ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    made = packed.groupBy("sequence_id").agg(ordered.alias("x"))
    return made.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
