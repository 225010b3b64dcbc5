"""Spelling variants of a corpus's words, found by two-dimensional range reporting.

Words that differ by one code point at an edit position share what stands before it and what stands after it. Before
it is an interval in the order of the words, after it an interval in the order of the reversed words; a word is a
point of its places in both orders. A wavelet tree over the points reports those in the rectangle of both intervals,
for each word and edit position; words of one length are a tree of their own, so that all it reports are near.

Words meet in groups. A group is of words of length c and c + 1, a region of edit positions, and what stands before
and after the region: two halves of all positions at first. A group of too many words has its region halved until it
is small or a single position, where the alphabet bounds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import ascii_lower, forget, parts, stored

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, so that a letter is a byte of Latin-1.
RUN = "([A-Za-zÀ-ÿ]+)"
#: Words of a group beyond which it is split, rows that a task compares at about a time, and positions at once.
GROUP, ROWS, POSITIONS = 8192, 1 << 16, 1 << 17


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, noise: int = 199) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` letters that occur at least ``least`` times.

    A word is a run of letters, A-Z lower-cased, that has lost a letter where ``noise`` divides its hash with the
    doc_id. A null text has no words; a null doc_id hashes as an empty one."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= shortest).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(h % noise == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class WaveletTree:
    """A permutation of 0 to n - 1, level by level: bits of the values from the highest down, zeros before ones."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for level in reversed(range(self.levels)):
            one = (values >> level) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in least <= value < below at the places lo to hi - 1 of each query."""
        query = np.flatnonzero((lo < hi) & (least < below))
        lo, hi, value = lo[query], hi[query], np.zeros(len(query), np.int64)
        for depth, zeros in enumerate(self.zeros):
            level = self.levels - 1 - depth
            a, b = zeros[lo], zeros[hi]
            query, value = np.concatenate([query, query]), np.concatenate([2 * value, 2 * value + 1])
            lo, hi = np.concatenate([a, zeros[-1] + lo - a]), np.concatenate([b, zeros[-1] + hi - b])
            open_ = (lo < hi) & (value << level < below[query]) & ((value + 1) << level > least[query])
            query, value, lo, hi = query[open_], value[open_], lo[open_], hi[open_]
        return query, value


class _Order:
    """Rows sorted by group and letters: places, and the interval of rows that share a row's first letters."""

    def __init__(self, group: np.ndarray, letters: np.ndarray):
        width = letters.shape[1]
        self.rows = np.lexsort((np.ascontiguousarray(letters).view(f"S{width}").ravel(), group))
        n = len(self.rows)
        self.place = np.empty(n, np.int64)
        self.place[self.rows] = np.arange(n)
        #: letters shared with the row before; -1 between groups
        self.shared = np.full(n + 1, -1, np.int64)
        for at in range(1, n, max(1, (1 << 22) // width)):
            to = min(n, at + max(1, (1 << 22) // width))
            apart = letters[self.rows[at:to]] != letters[self.rows[at - 1 : to - 1]]
            self.shared[at:to] = np.where(apart.any(1), apart.argmax(1), width)
        self.shared[1:n][np.diff(group[self.rows]) != 0] = -1
        #: least[j][k]: of shared[k : k + 2**j]
        self.least = [self.shared]
        while (half := 1 << (len(self.least) - 1)) * 2 <= n + 1:
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def longest(self) -> np.ndarray:
        """The most letters each row shares with another of its group; -1 if it has no other."""
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.maximum(self.shared[:-1], self.shared[1:])
        return out

    def interval(self, row: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that share the first ``letters`` of ``row``: from, and up to but without."""
        lo, hi = self.place[row].copy(), self.place[row] + 1
        for j in reversed(range(len(self.least))):
            least, step = self.least[j], 1 << j
            at = lo - step + 1
            lo -= np.where((at >= 0) & (least[np.clip(at, 0, len(least) - 1)] >= letters), step, 0)
            hi += np.where((hi < len(least)) & (least[np.clip(hi, 0, len(least) - 1)] >= letters), step, 0)
        return lo, hi


class _Points:
    """The rows of one length as points of their places in both orders."""

    def __init__(self, member: np.ndarray, forward: _Order, backward: _Order):
        self.upto = [np.concatenate([[0], np.cumsum(member[o.rows])]) for o in (forward, backward)]
        #: rows by their place among the members in the order of reversed words
        self.rows = backward.rows[member[backward.rows]]
        place = np.empty(len(member), np.int64)
        place[self.rows] = np.arange(len(self.rows))
        self.tree = WaveletTree(place[forward.rows[member[forward.rows]]]) if len(self.rows) else None

    def within(self, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows in the rectangle of two intervals of places for each query."""
        if self.tree is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, value = self.tree.report(*(self.upto[0][x] for x in before), *(self.upto[1][x] for x in after))
        return query, self.rows[value]


def near_of(words: list[bytes], n: np.ndarray, group: np.ndarray, c: int, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of c or c + 1 letters: how many near words each has by edits in its group's region, and the row of
    the one of largest n, of equals the first in order; -1 if there is none. The region is [first, end) of the words
    of c letters, whose places from 0 to c are those of insertions."""
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    letters = np.frombuffer(b"".join(w.ljust(c + 1, b"\0") for w in words), np.uint8).reshape(-1, c + 1)
    short = letters[:, c] == 0
    reverse = letters[:, ::-1].copy()
    reverse[short, :-1], reverse[short, -1] = reverse[short, 1:], 0
    forward, backward = _Order(group, letters), _Order(group, reverse)
    same, longer = _Points(short, forward, backward), _Points(~short, forward, backward)
    before, after = forward.longest(), backward.longest()

    def note(word: np.ndarray, other: np.ndarray) -> None:
        count[:] += np.bincount(word, minlength=len(words))
        word, other = np.concatenate([word, np.flatnonzero(best >= 0)]), np.concatenate([other, best[best >= 0]])
        order = np.lexsort((forward.place[other], -n[other], word))
        word, other = word[order], other[order]
        lead = np.diff(word, prepend=-1) != 0
        best[word[lead]] = other[lead]

    for points, gone in ((same, 1), (longer, 0)):
        # an edit at i keeps i letters before it and c - i - gone after it; both have to be shared with another word
        lo = np.maximum(first, c - gone - after)
        hi = np.minimum(np.minimum(end, c + 1 - gone), before + 1)
        asked = np.flatnonzero(short & (lo < hi) & (before >= 0))
        sizes = (hi - lo)[asked]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, int(upto[-1]), POSITIONS):
            k = np.arange(at, min(at + POSITIONS, int(upto[-1])))
            which = np.searchsorted(upto, k, "right") - 1
            row = asked[which]
            i = lo[row] + k - upto[which]
            query, other = points.within(forward.interval(row, i), backward.interval(row, c - i - gone))
            word, i = row[query], i[query]
            if gone:
                other, word = other[other != word], word[other != word]
                note(word, other)
            else:
                # within a run of one letter, all insertions of it make the same word: the last place counts
                last = letters[word, i] != letters[other, i]
                note(np.concatenate([word[last], other[last]]), np.concatenate([other[last], word[last]]))
    return count, best


def _compare(table: pa.Table) -> pa.Table:
    c = table.column("c").to_numpy()
    words, near, best_n, best = [], [], [], []
    for size in np.unique(c).tolist():
        own = table.filter(pa.array(c == size))
        texts = own.column("word").to_pylist()
        n = own.column("n").to_numpy()
        group = own.column("key").combine_chunks().dictionary_encode()
        group = (group if isinstance(group, pa.DictionaryArray) else group.combine_chunks()).indices.to_numpy()
        count, other = near_of([w.encode("latin-1") for w in texts], n, group, size, own.column("first").to_numpy(), own.column("end").to_numpy())
        for k in np.flatnonzero(count).tolist():
            words.append(texts[k])
            best.append(texts[other[k]])
        near.append(count[count > 0])
        best_n.append(n[other[count > 0]])
    none = np.zeros(0, np.int64)
    return pa.table({"word": pa.array(words, pa.string()), "near": np.concatenate([none, *near]), "best_n": np.concatenate([none, *best_n]).astype(np.int64), "best": pa.array(best, pa.string())})


def _regions(rows: DataFrame, halves: list[tuple]) -> DataFrame:
    """A row for each of ``halves``, pairs of columns, of its region."""
    regions = F.explode(F.array(*[F.struct(F.col("c"), first.cast("int").alias("first"), end.cast("int").alias("end")) for first, end in halves])).alias("r")
    rows = rows.select("word", "n", regions).select("word", "n", "r.*")
    tail = F.greatest(F.col("c") - F.col("end"), F.lit(0))
    after = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    key = F.concat_ws("|", "c", "first", "end", F.substring("word", F.lit(1), F.col("first")), after)
    return rows.withColumn("key", key)


def near_words(words: DataFrame, shortest: int = 6, group: int = GROUP, rows: int = ROWS) -> DataFrame:
    """word, n_near, best_n and best of each of ``words`` (word, n; distinct, of Latin-1 letters) that has near words.

    Near are words that differ by one inserted, deleted or replaced letter. Each pair is found once: an edit position
    lies in one region, and of equal insertions one counts. Words stand in four groups, more only where a group has
    over ``group`` words and its region is halved; no group is left out or cut."""
    spark = ship(words.sparkSession)
    by_class = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("c")).where(F.col("c") >= shortest)
    middle = F.floor((F.col("c") + 1) / 2)
    held = stored(_regions(by_class, [(F.lit(0), middle), (middle, F.col("c") + 1)]), "regions")
    while True:
        large = stored(held.where(F.col("end") - F.col("first") > 1).groupBy("key").count().where(F.col("count") > group).select(F.col("key").alias("large")), "large")
        if large.isEmpty():
            break
        marked = held.join(large, held["key"] == large["large"], "left")
        middle = F.floor((F.col("first") + F.col("end")) / 2)
        split = _regions(marked.where(F.col("large").isNotNull()), [(F.col("first"), middle), (middle, F.col("end"))])
        after = stored(marked.where(F.col("large").isNull()).drop("large").unionByName(split), "regions")
        forget(held)
        held = after
    deals = max(parts(spark), held.count() // rows)
    found = held.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(deals))).groupBy("deal").applyInArrow(_compare, "word string, near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form; no circles): the last of the chain of forms, by pointer doubling."""
    up = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = stored(up.join(next_, up["root"] == next_["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        forget(up)
        up = joined
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, noise: int = 199) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of ``docs``, see :func:`word_counts`.

    A word's form is its near word of largest n, of equals the first by code points, if that is at least ``ratio``
    times its own; its root is the last of the chain of forms, itself if it has none. Repeated rows count each; other
    columns of ``docs`` are not read. No rows, no words, no result."""
    words = stored(word_counts(docs, shortest, least, noise), "words")
    found = near_words(words, shortest).select(F.col("word").alias("_word"), "n_near", "best_n", "best")
    better = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(found, words["word"] == found["_word"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    rows = stored(rows, "forms")
    up = roots(rows.where("form is not null")).select(F.col("word").alias("_word"), "root")
    return rows.join(up, rows["word"] == up["_word"], "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
