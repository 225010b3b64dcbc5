"""A Brown class-based bigram model: exchange clustering of words, class transitions, word emissions.

Words are known by 64-bit hashes. Counts cover the whole training part and stay in a distributed table. Classes of
the most frequent words seed the exchange; then all words seen more than once choose among them in rounds, by their
bigrams with the classes under the last assignment. Classes of words above a count threshold, at most ``frequent``
of them, are sent to executors; all other words are rows of a table and their classes meet tokens in shuffle joins.
Words seen once and unknown ones share a class, and the end of a text has its own.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import forget, parts, stored
from .tokens import Words, slices

END = 0x5DEECE66D
_HOLD = 1 << 21


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of all texts, each text followed by END; and where each text begins (len + 1)."""
    words = Words(texts, lower=True)
    n = np.diff(words.by_doc)
    begin = words.by_doc + np.arange(len(n) + 1)
    out = np.full(len(words) + len(n), END, np.int64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words.hashes().view(np.int64)
    return out, begin


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)


def _rows(keys: np.ndarray, counts: np.ndarray):
    for i in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], ["key", "c"])


def count_words(docs: DataFrame) -> DataFrame:
    """(key, c) of every token of ``docs.text``; a task merges its counts before the shuffle."""

    def count(batches):
        keys, counts = [], []
        for whole in batches:
            for batch in slices(whole, "text"):
                k, c = np.unique(tokens_of(batch.column("text"))[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > _HOLD:
                    k, c = merged(keys, counts)
                    keys, counts = [k], [c]
                    if len(k) > _HOLD // 2:
                        yield from _rows(k, c)
                        keys, counts = [], []
        if keys:
            yield from _rows(*merged(keys, counts))

    return docs.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _texts_of(column: pa.Array, dtype: str) -> np.ndarray:
    """The numbers of all values of a binary column on end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    size = np.dtype(dtype).itemsize
    if column.buffers()[2] is None:
        return np.zeros(0, dtype)
    return np.frombuffer(column.buffers()[2], dtype, (offsets[-1] - offsets[0]) // size, offsets[0])


def _binary(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A binary column whose values are values[begin[i]:begin[i + 1]]."""
    offsets = (begin * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def code_texts(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """doc_id, held_out, low, high and rare of each text, stored: its tokens by their places in ``keys``.

    END has the place after the last key and every other token the one after that, its own key being in ``rare``.
    low and high are the 16 low bits and the byte above them. All later passes read these instead of texts."""
    own = np.append(keys, END)
    order = np.argsort(own)
    sent, rest = docs.sparkSession.sparkContext.broadcast((own[order], order)), len(own)

    def code(batches):
        sorted_, place = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, begin = tokens_of(batch.column("text"))
                at = np.minimum(np.searchsorted(sorted_, tokens), len(sorted_) - 1)
                u = np.where(sorted_[at] == tokens, place[at], rest)
                rare = u == rest
                first = np.concatenate([[0], np.cumsum(rare)])[begin]
                columns = [_binary(u.astype("<u2"), begin), _binary((u >> 16).astype(np.uint8), begin), _binary(tokens[rare], first)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "low", "high", "rare"])

    return stored(docs.select("doc_id", "held_out", "text").mapInArrow(code, "doc_id long, held_out boolean, low binary, high binary, rare binary"), "coded")


def places(batch: pa.RecordBatch) -> np.ndarray:
    return _texts_of(batch.column("low"), "<u2").astype(np.int64) | (_texts_of(batch.column("high"), "u1").astype(np.int64) << 16)


#: Bytes of ``low`` that are read at once.
_PIECE = 1 << 20


def exchange(pairs: np.ndarray, clustered: int, classes: int, sweeps: int = 6) -> np.ndarray:
    """Classes of the units of a bigram matrix by greedy exchange, maximising class bigram likelihood.

    The first ``clustered`` units, by falling frequency, go to ``classes`` classes; each other unit is a class
    of its own, numbered on from there."""
    units = len(pairs)
    of = np.concatenate([np.arange(clustered) % classes, classes + np.arange(units - clustered)])
    n = classes + units - clustered
    f = lambda x: x * np.log(np.maximum(x, 1))
    pairs = pairs.astype(float)
    hot = np.zeros((units, n))
    hot[np.arange(units), of] = 1
    m = hot.T @ pairs @ hot
    for _ in range(sweeps if min(clustered, classes) > 1 else 0):
        moved = 0
        for w in range(clustered):
            a, self_ = of[w], pairs[w, w]
            out, in_ = np.bincount(of, pairs[w], n), np.bincount(of, pairs[:, w], n)
            out[a] -= self_
            in_[a] -= self_
            m[a, :] -= out
            m[:, a] -= in_
            m[a, a] -= self_
            # a class's totals hold its bigrams with w wherever w goes
            row, col = (m.sum(1) + in_)[:classes], (m.sum(0) + out)[:classes]
            k = np.arange(classes)
            gain_row = f(m[:classes] + out[None, :]) - f(m[:classes])
            gain_col = (f(m[:, :classes] + in_[:, None]) - f(m[:, :classes])).T
            both = f(m[k, k] + out[:classes] + in_[:classes] + self_) - f(m[k, k])
            gain = gain_row.sum(1) - gain_row[k, k] + gain_col.sum(1) - gain_col[k, k] + both
            gain -= f(row + out.sum() + self_) - f(row) + f(col + in_.sum() + self_) - f(col)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            m[b, :] += out
            m[:, b] += in_
            m[b, b] += self_
            moved += b != a
            of[w] = b
        if not moved:
            break
    return of


def best_classes(stat: np.ndarray, own: np.ndarray, m: np.ndarray, classes: int) -> np.ndarray:
    """The class of greatest class bigram likelihood of each word, all others staying where they are.

    ``stat`` has a row for each word: its bigrams to each of the n classes, those from each, and those with itself
    (2 n + 1). ``own`` is the word's present class and ``m`` the n x n bigrams of all classes. Only the first
    ``classes`` can be moved to; a word stays in one of them unless another is better."""
    n, f = len(m), lambda x: x * np.log(np.maximum(x, 1))
    m, result = m.astype(float), np.empty(len(stat), np.int64)
    filled = np.cumsum(np.count_nonzero(stat, axis=1) + 1)
    total = m.sum(1)[:classes]
    at = 0
    while at < len(stat):
        to = max(at + 1, int(np.searchsorted(filled, filled[at] + (1 << 20) // classes)))
        x, a = stat[at:to].astype(float), own[at:to]
        out, in_, self_ = x[:, :n], x[:, n : 2 * n], x[:, 2 * n :]
        inside, w = np.flatnonzero(a < classes), np.arange(to - at)
        d = np.repeat(np.diag(m)[None, :classes], to - at, 0)
        d[inside, a[inside]] -= (out[w, a] + in_[w, a] + self_[:, 0])[inside]
        gain = f(d + out[:, :classes] + in_[:, :classes] + self_) - f(d)
        c = out.sum(1, keepdims=True) + self_
        t = np.repeat(total[None], to - at, 0)
        t[inside, a[inside]] -= c[inside, 0]
        gain -= 2 * (f(t + c) - f(t))
        for side, other, cells in ((out, in_, m.T), (in_, out, m)):
            i, j = np.nonzero(side)
            if not len(i):
                continue
            v, had = side[i, j][:, None], cells[j, :classes]
            left = np.flatnonzero(j == a[i])  # the word's bigrams from or to the class that it leaves
            had[left] -= other[i[left], :classes]
            some = np.flatnonzero(a[i] < classes)
            had[some, a[i[some]]] -= v[some, 0]
            more = f(np.maximum(had, 0) + v) - f(np.maximum(had, 0))
            some = np.flatnonzero(j < classes)
            more[some, j[some]] = 0
            first = np.flatnonzero(np.diff(i, prepend=-1))
            gain[i[first]] += np.add.reduceat(more, first)
        new = gain.argmax(1)
        stays = np.zeros(to - at, bool)
        stays[inside] = gain[inside, new[inside]] <= gain[inside, a[inside]] + 1e-9
        result[at:to] = np.where(stays, a, new)
        at = to
    return result


def likelihood(m: np.ndarray) -> float:
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    m = m.astype(float)
    return float(f(m) - f(m.sum(0)) - f(m.sum(1)))


def _packed(code: np.ndarray, count: np.ndarray, block: int, size: int):
    """Rows (block, codes, counts) of sorted codes; steps and counts by byte planes, as most high bytes are 0."""
    cut = np.searchsorted(code, np.arange(int(code[-1]) // size + 2) * size) if len(code) else [0]
    for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        for k in range(i, j, 1 << 17):
            e = min(k + (1 << 17), j)
            steps = np.diff(code[k:e] - b * size, prepend=0).astype("<i4")
            planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, count[k:e].astype("<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([block + b]), pa.array([planes[0]], pa.binary()), pa.array([planes[1]], pa.binary())], ["block", "codes", "counts"])


def _unpacked(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    read = lambda b: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    return np.cumsum(read(codes)), read(counts)


_PACKED = "block long, codes binary, counts binary"


def _block(n: int) -> int:
    """How many words' bigrams with n classes a task holds at once."""
    return max(1, (1 << 18) // (2 * n + 1))


def _beside(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all values of a list column that are not negative."""
    i, v = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()
    return i[v >= 0], v[v >= 0]


class Clustering:
    """Exchange in rounds over all words seen more than once, beginning with seeds exchanged on the driver.

    Classes of the frequent words are broadcast, by place in falling order of count; END and a place for all other
    tokens follow. The other words are rows of ``words``, with the places beside each occurrence, -1 where that is
    no frequent word either: such neighbours meet their classes by a join (``pairs``). In the first round all
    words leave the rare class under the seeds' classes; in each later one half of the words may move. A round that
    lowers the likelihood is undone and is the last."""

    def __init__(self, coded: DataFrame, keys: np.ndarray, clustered: int, classes: int, rounds: int):
        self.spark, self.docs, self.classes, self.n, self.rare = coded.sparkSession, coded.select("low", "high"), classes, classes + 2, classes + 1
        self.end, self.rest, self.keys = len(keys), len(keys) + 1, keys
        # with fewer seeds than classes, all other words begin spread over these, wherever they are held
        spread = clustered < classes
        self.of = np.append(keys % classes if spread else np.full(len(keys), self.rare), [classes, self.rare])
        self.of[:clustered] = self.seeds(clustered)
        self.words, self.pairs = self.others(coded.select("low", "high", "rare"), spread)
        known = None
        for k in range(rounds + 1):
            scanned = stored(self.docs.mapInArrow(self.scan(k < rounds), _PACKED), "bigrams")
            pairs = stored(self.resolved(), "resolved")
            m = self.totals(scanned, pairs)
            if k > 1 and likelihood(m) < likelihood(known[0]):
                self.m, self.of, self.words = known
                return
            self.m = m
            known = m, self.of, self.words
            if k < rounds:
                self.of, self.words = self.moved_frequent(scanned, k), self.moved_others(pairs, k)
            forget(scanned)
            forget(pairs)

    def placed(self):
        """For a task: each piece's batch, the places of its tokens and the places before them."""
        end = self.end

        def read(batches):
            for whole in batches:
                for batch in slices(whole, "low", _PIECE):
                    u = places(batch)
                    # every text follows an end
                    yield batch, u, np.concatenate([[end], u[:-1]])

        return read

    def seeds(self, clustered: int) -> np.ndarray:
        units, read, end = clustered + 2, self.placed(), self.end

        def bigrams(batches):
            found = np.zeros(units * units, np.int64)
            unit = lambda u: np.where(u < clustered, u, np.where(u == end, clustered, clustered + 1))
            for _, u, before in read(batches):
                found += np.bincount(unit(before) * units + unit(u), minlength=len(found))
            some = np.flatnonzero(found)
            yield from _rows(some, found[some])

        # at most units ** 2 rows
        pairs = self.docs.mapInArrow(bigrams, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
        matrix = np.zeros(units * units, np.int64)
        matrix[pairs.column("key").to_numpy()] = pairs.column("c").to_numpy()
        return exchange(matrix.reshape(units, units), clustered, min(self.classes, max(clustered, 1)))[:clustered]

    def others(self, docs: DataFrame, spread: bool) -> tuple[DataFrame, DataFrame]:
        read, rest = self.placed(), self.rest

        def occurrences(batches):
            for batch, u, before in read(batches):
                at, tokens = np.flatnonzero(u == rest), _texts_of(batch.column("rare"), "<i8")
                after = u[np.minimum(at + 1, len(u) - 1)]  # an end follows at least
                beside = lambda x: pa.array(np.where(x == rest, -1, x).astype(np.int32))
                again = before[at] == rest
                key = pa.array(np.roll(tokens, 1), mask=~again)  # the one before is a rare token too
                yield pa.RecordBatch.from_arrays([pa.array(tokens), beside(before[at]), beside(after), key], ["key", "l", "r", "before"])

        found = stored(docs.mapInArrow(occurrences, "key long, l int, r int, before long"), "occurrences")
        words = found.groupBy("key").agg(F.count("*").alias("c"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r")).where("c > 1")
        of = F.pmod("key", F.lit(self.classes)) if spread else F.lit(self.rare)
        words = stored(words.select("key", "c", of.cast("long").alias("of"), "l", "r"), "words")
        pairs = stored(found.where("before is not null").select(F.col("before").alias("a"), F.col("key").alias("b")), "pairs")
        forget(found)
        return words, pairs

    def resolved(self) -> DataFrame:
        """a, b, a_of and b_of of the bigrams of two words that are not frequent."""
        a, b = (self.words.select(F.col("key").alias(x), F.col("of").alias(f"{x}_of")) for x in "ab")
        both = self.pairs.join(a, "a", "left").join(b, "b", "left")
        return both.select("a", "b", *(F.coalesce(x, F.lit(self.rare)).cast("long").alias(x) for x in ("a_of", "b_of")))

    def scan(self, words: bool):
        """Packed bigrams of classes (block -1) and, if asked for, of frequent words with classes."""
        read, sent, n, end = self.placed(), self.spark.sparkContext.broadcast(self.of), self.n, self.end
        width, size = 2 * n + 1, _block(n) * (2 * n + 1)

        def counted(batches):
            m, codes = np.zeros(n * n, np.int64), []
            of = sent.value
            for _, u, before in read(batches):
                m += np.bincount(of[before] * n + of[u], minlength=n * n)
                if words:
                    same = before == u
                    codes.append((before * width + np.where(same, 2 * n, of[u]))[before < end])
                    codes.append((u * width + n + of[before])[(u < end) & ~same])
                    if sum(map(len, codes)) > 2 * _HOLD:
                        yield from _packed(*np.unique(np.concatenate(codes), return_counts=True), 0, size)
                        codes = []
            if codes:
                yield from _packed(*np.unique(np.concatenate(codes), return_counts=True), 0, size)
            yield from _packed(np.flatnonzero(m), m[m > 0], -1, n * n)

        return counted

    def totals(self, scanned: DataFrame, pairs: DataFrame) -> np.ndarray:
        """The bigrams of all classes: as scanned, with the words of ``words`` moved from the rare class to theirs."""
        n, rare, sent = self.n, self.rare, self.spark.sparkContext.broadcast(self.of)

        def unpacked(batches):
            m = np.zeros(n * n, np.int64)
            for batch in batches:
                for x, y in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    at, c = _unpacked(x, y)
                    m[at] += c
            yield from _rows(np.flatnonzero(m), m[m != 0])

        def moved(batches):
            m = np.zeros(n * n, np.int64)
            for batch in batches:
                own = batch.column("of").to_numpy()
                (i, l), (j, r) = _beside(batch.column("l")), _beside(batch.column("r"))
                l, r = sent.value[l], sent.value[r]
                m += np.bincount(l * n + own[i], minlength=n * n) - np.bincount(l * n + rare, minlength=n * n)
                m += np.bincount(own[j] * n + r, minlength=n * n) - np.bincount(rare * n + r, minlength=n * n)
            yield from _rows(np.flatnonzero(m), m[m != 0])

        of_pair = F.col("a_of") * n + F.col("b_of")
        met = pairs.groupBy(of_pair.alias("key")).agg(F.count("*").alias("c"))
        back = pairs.agg(F.lit(rare * n + rare).cast("long").alias("key"), (-F.count("*")).alias("c"))
        rows = scanned.where("block < 0").mapInArrow(unpacked, "key long, c long")
        rows = rows.unionByName(self.words.select("of", "l", "r").mapInArrow(moved, "key long, c long")).unionByName(met).unionByName(back)
        # at most n ** 2 rows
        found = rows.groupBy("key").agg(F.sum("c").alias("c")).toArrow()
        m = np.zeros(n * n, np.int64)
        m[found.column("key").to_numpy()] = found.column("c").to_numpy()
        return m.reshape(n, n)

    def moved_frequent(self, scanned: DataFrame, k: int) -> np.ndarray:
        n, rare, classes, end, keys = self.n, self.rare, self.classes, self.end, self.keys
        width, block = 2 * n + 1, _block(n)
        sent = self.spark.sparkContext.broadcast((self.of, self.m, keys))

        def from_words(batches):
            of = sent.value[0]
            codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch in batches:
                own = batch.column("of").to_numpy()
                for column, side in (("l", 0), ("r", n)):
                    i, v = _beside(batch.column(column))
                    i, v = i[v < end], v[v < end]
                    codes += [v * width + side + own[i], v * width + side + rare]
                    counts += [np.ones(len(v)), -np.ones(len(v))]
                if sum(map(len, codes)) > _HOLD:
                    yield from _packed(*merged(codes, counts), 0, block * width)
                    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            yield from _packed(*merged(codes, counts), 0, block * width)

        def choose(batches):
            of, m, own_keys = sent.value
            at, stat = None, None

            def chosen():
                w = np.arange(at * block, min((at + 1) * block, end))
                new = best_classes(stat.reshape(block, width)[: len(w)], of[w], m, classes)
                new = np.where((of[w] < classes) & ((own_keys[w] & 1) != k % 2), of[w], new)
                return pa.RecordBatch.from_arrays([pa.array(w), pa.array(new)], ["place", "of"])

            for batch in batches:
                for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "counts")), strict=True):
                    if b != at:
                        if at is not None:
                            yield chosen()
                        at, stat = b, np.zeros(block * width, np.int64)
                    code, c = _unpacked(x, y)
                    stat[code] += c
            if at is not None:
                yield chosen()

        rows = scanned.where("block >= 0").unionByName(self.words.where(F.col("of") != rare).select("of", "l", "r").mapInArrow(from_words, _PACKED))
        # at most a row for each frequent word
        found = rows.repartition(parts(self.spark), "block").sortWithinPartitions("block").mapInArrow(choose, "place long, of long").toArrow()
        new = self.of.copy()
        new[found.column("place").to_numpy()] = found.column("of").to_numpy()
        return new

    def moved_others(self, pairs: DataFrame, k: int) -> DataFrame:
        n, classes = self.n, self.classes
        width = 2 * n + 1
        sent = self.spark.sparkContext.broadcast((self.of, self.m))

        def choose(batches):
            of, m = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    own, keys = batch.column("of").to_numpy(), batch.column("key").to_numpy()
                    codes = []
                    for column, cell in (("l", lambda v: n + of[v]), ("r", lambda v: of[v]), ("cells", lambda v: v)):
                        i, v = _beside(batch.column(column))
                        codes.append(i * width + cell(v))
                    stat = np.bincount(np.concatenate(codes), minlength=len(own) * width).reshape(-1, width)
                    new = best_classes(stat, own, m, classes)
                    new = np.where((own < classes) & ((keys & 1) != k % 2), own, new)
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("c"), pa.array(new), batch.column("l"), batch.column("r")], ["key", "c", "of", "l", "r"])

        same = F.col("a") == F.col("b")
        cells = pairs.select(F.col("a").alias("key"), F.when(same, F.lit(2 * n)).otherwise(F.col("b_of")).cast("int").alias("cell"))
        cells = cells.unionByName(pairs.where(~same).select(F.col("b").alias("key"), (F.col("a_of") + n).cast("int").alias("cell")))
        cells = cells.groupBy("key").agg(F.collect_list("cell").alias("cells"))
        words = self.words.join(cells, "key", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<int>")))
        return stored(words.select("key", "c", "of", "l", "r", "cells").mapInArrow(choose, self.words.schema), "words")


class Model:
    """What executors need, by place: counts, classes and log emissions of frequent words and END; log class transitions."""

    def __init__(self, counts: np.ndarray, of: np.ndarray, m: np.ndarray, total: int, distinct: int, prior: float = 10.0):
        self.counts, self.of, self.rest, self.rare = counts.astype(float), of.astype(np.int64), len(counts), len(m) - 1
        m = m.astype(float)
        seen = m.sum(0)  # every token follows another or an end
        self.mass_log = np.log10(np.maximum(seen, 1))
        self.emission = np.log10(np.maximum(self.counts, 1)) - self.mass_log[self.of]
        #: the rare class has the words seen once and one unknown word: a word's emission is log10(c + 1) less this
        self.rare_log = math.log10(2 * seen[self.rare] + 1)
        back_off = (seen + 1) / (seen.sum() + len(m))
        self.transition = np.log10((m + prior * back_off) / (m.sum(1, keepdims=True) + prior))
        self.base_log = math.log10(total + distinct + 1)


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def classes_for(words: int) -> int:
    """How many classes that many words get: 20 for 20,000, 71 for 1.5 million."""
    return max(2, round(words**0.3))


class Trained(NamedTuple):
    model: Model
    #: the frequent words, by place
    keys: np.ndarray
    #: all texts, see :func:`code_texts`
    coded: DataFrame
    #: all other words: key, c, of
    others: DataFrame
    #: number of training tokens
    total: int


def train(docs: DataFrame, frequent: int = 1 << 17, clustered: int = 512, classes: int | None = None, rounds: int = 2) -> Trained:
    """Learn a model and code the texts.

    ``docs`` has doc_id, held_out and text; rows that are not held out are learned from, all are coded.
    ``frequent`` bounds what the driver and a broadcast hold beside the seeds; it changes no class. ``clustered`` is how
    many words seed the rounds; neither bounds what is clustered. The number of classes follows the vocabulary unless
    given. There are ``rounds`` rounds, one less where one gains nothing: the exchange need not have come to rest."""
    ship(docs.sparkSession)
    counts = stored(count_words(docs.where("not held_out")), "counts")
    total, distinct, more = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") > 1)).first())
    classes = classes or classes_for(more)
    level = F.floor(F.log2("c") * 8).cast("int")
    often = counts.where((F.col("c") > 1) & (F.col("key") != END))  # words seen once stand for the unseen ones in the rare class
    held, least = 0, None
    for r in often.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # at most 8 * 63 rows
        held += r["count"]
        if held > frequent:
            break
        least = r["level"]
    # the seeds are the same words whatever the bound: the most frequent ones, of equals the least keys
    first = often.orderBy(F.col("c").desc(), "key").limit(clustered)
    top = (often.where(level >= least).unionByName(first) if least is not None else first).distinct().toArrow()
    keys, n = top.column("key").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    coded = code_texts(docs, keys)
    made = Clustering(coded.where("not held_out"), keys, min(clustered, len(keys)), classes, rounds)
    model = Model(np.append(n, made.m.sum(0)[classes]), made.of[: len(keys) + 1], made.m, total, distinct)
    single = counts.where((F.col("c") == 1) & (F.col("key") != END)).select("key", "c", F.lit(model.rare).cast("long").alias("of"))
    return Trained(model, keys, coded, made.words.select("key", "c", "of").unionByName(single), total)


def score(docs: DataFrame, frequent: int = 1 << 17, clustered: int = 512, classes: int | None = None, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2. Tokens are the lower-cased (A-Z) words
    ``[^\\x20\\x09-\\x0D]+`` and one end per text. base_score sums log10((c + 1) / (N + V + 1)) over the tokens;
    score is the class model's log10 probability of the text, and perplexity 10 ** (-score / n_tokens).

    Null and empty texts are an end only. A null doc_id is learned from. Rows are scored one by one whatever
    their doc_id. Without training rows every word is unknown: N and V are 0. An empty table gives an empty
    result. Ties between classes go to the lower number, so reruns agree.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model, _, coded, others, total = train(docs, frequent, clustered, classes, rounds)
    sent = spark.sparkContext.broadcast(model)

    def one_by_one(batches):
        m = sent.value
        of, counts, emission = np.append(m.of, m.rare), np.append(m.counts, 0), np.append(m.emission, 0)
        for whole in batches:
            for batch in slices(whole, "low", _PIECE):
                u = places(batch)
                n = np.diff(np.append(-1, np.flatnonzero(u == m.rest - 1)))
                s = np.cumsum(n) - n
                known = u < m.rest
                c = of[u]
                before = np.concatenate([[of[m.rest - 1]], c[:-1]])  # a text follows an end
                # tokens that are not frequent meet their classes later, and their transitions with them
                late = np.append(False, ~known[:-1])
                log = np.where(known & ~late, m.transition[before, c], 0) + emission[u]
                base = np.log10(counts + 1)[u]
                offsets = np.append(0, np.cumsum(~known))[np.append(s, len(u))].astype(np.int32)
                # place, class before and after, each plus one and 0 if that is late too
                at = np.flatnonzero(~known)
                after = np.where(known[at + 1], c[at + 1] + 1, 0)  # an end follows at least
                place = at - np.repeat(s, n)[at]
                info = (place << 32) | (np.where(late[at], 0, before[at] + 1) << 16) | after
                sums = (np.add.reduceat(x, s) for x in ((counts > 0).astype(np.int64)[u], base, log))
                n_known, base, log = sums
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(n_known), pa.array(base - n * m.base_log), pa.array(log), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_texts_of(batch.column("rare"), "<i8"))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(info))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "info"],
                )

    scored = coded.mapInArrow(one_by_one, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, info array<long>")
    # numbered once, as written
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    forget(coded)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "info")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.info").alias("info"))
    rare = rare.join(others, "key", "left").select("row", F.struct("info", F.coalesce("of", F.lit(model.rare)).cast("int").alias("of"), F.coalesce("c", F.lit(0)).alias("c")).alias("x"))
    rare = rare.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    out = scored.drop("rare", "info").join(rare, "row", "left").drop("row").withColumn("x", F.coalesce("x", F.array().cast("array<struct<info:bigint,of:int,c:bigint>>")))

    def late_ones(batches):
        m = sent.value
        for batch in batches:
            x = batch.column("x")
            i, (info, of, c) = np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())), (v.to_numpy() for v in x.flatten().flatten())
            before, after = (info >> 16) & 0xFFFF, info & 0xFFFF
            before = np.where(before > 0, before - 1, np.append(0, of[:-1]))
            log = m.transition[before, of] + np.where(after > 0, m.transition[of, np.maximum(after - 1, 0)], 0)
            log += np.where(of == m.rare, np.log10(c + 1) - m.rare_log, np.log10(np.maximum(c, 1)) - m.mass_log[of])
            add = lambda name, v: pa.array(batch.column(name).to_numpy() + np.bincount(i, v, len(x)).astype(v.dtype))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), add("n_known", (c > 0).astype(np.int64)), add("base_score", np.log10(c + 1.0)), add("score", log)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            )

    out = out.mapInArrow(late_ones, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
