"""Fill-in-the-middle transformation by a parallel scan of an automaton.

Tokens of a text are runs of space with the word that follows, and a last run of space. An automaton over bytes reads
them: it knows whether it is in space or in a word and how much of a marker ``<P>``, ``<S>`` or ``<M>`` it has just
read, and it counts ends of words and markers. A block of bytes is a function from entry state to exit state, with
the counts for each entry state; functions compose associatively, so blocks are read at once, whatever stands before
them, and a prefix composition gives their entry states. A cut after k tokens is in the block in which the running
count reaches k.

Blocks are rows of an array where a text fits a batch. A longer text is dealt into pieces that are rows of their own
in any task: each piece emits its function, functions compose in a tree, and the pieces that hold the cuts find them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.workers import ship

from .common import stored, text_key
from .tokens import IN_WORD, slices, utf8

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Texts of more bytes are dealt into pieces of about so many, which other tasks read.
LONG = 1 << 16
#: Bytes of a block, and how many functions of pieces one task composes at a time.
BLOCK, FAN_IN = 64, 256

#: States: in space (or at the start), in a word, after ``<`` and after ``<`` with one of P, S, M.
SPACE, WORD, OPEN, NAMED = range(4)
STATES = 4
#: Classes of bytes: space, other, ``<``, a marker's letter, ``>``, and nothing, which pads a block.
_SPACE, _OTHER, _OPEN, _LETTER, _CLOSE, _NONE = range(6)
CLASS = np.where(IN_WORD, _OTHER, _SPACE).astype(np.uint8)
CLASS[[ord(c) for c in "<>"]] = _OPEN, _CLOSE
CLASS[[ord(m[1]) for m in MARKS.values()]] = _LETTER
NEXT = np.full((6, STATES), WORD, np.int8)
NEXT[_SPACE], NEXT[_OPEN], NEXT[_NONE] = SPACE, OPEN, np.arange(STATES)
NEXT[_LETTER, OPEN] = NAMED
#: What a step counts: the end of a word, a whole marker.
WORD_END = np.zeros((6, STATES), np.int64)
WORD_END[_SPACE, WORD:] = 1
MARKER = np.zeros((6, STATES), np.int64)
MARKER[_CLOSE, NAMED] = 1


def _scan(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exit state, word ends and markers of each block (a row of ``classes``) for each entry state."""
    n = len(classes)
    state = np.tile(np.arange(STATES, dtype=np.int8), (n, 1))
    ends, marks = np.zeros((n, STATES), np.int64), np.zeros((n, STATES), np.int64)
    for step in classes.T:
        cell = step[:, None].astype(np.int64) * STATES + state
        ends += WORD_END.take(cell)
        marks += MARKER.take(cell)
        state = NEXT.take(cell)
    return state, ends, marks


def _entries(functions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Entry state of each block: the composition of all functions before it. ``first`` blocks begin a text.

    Made by doubling: after step d a row holds the composition of the d functions up to it."""
    f = functions.astype(np.int8).copy()
    f[first] = f[first, SPACE][:, None]  # what stood before a text does not matter
    d = 1
    while d < len(f):
        f[d:] = np.take_along_axis(f[d:], f[:-d].astype(np.int64), axis=1)
        d *= 2
    before = np.full(len(f), SPACE, np.int8)
    before[1:] = f[:-1, SPACE]
    before[first] = SPACE
    return before


class Scan:
    """Texts on end (``data`` with ``offsets``) cut into blocks, each text beginning one of its own."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        sizes = np.diff(offsets)
        self.n_blocks = -(-sizes // BLOCK)
        self.by_text = np.concatenate([[0], np.cumsum(self.n_blocks)])
        text = np.repeat(np.arange(len(sizes)), self.n_blocks)
        self.start = offsets[text] + (np.arange(len(text)) - self.by_text[text]) * BLOCK
        at = self.start[:, None] + np.arange(BLOCK)
        inside = at < offsets[text + 1][:, None]
        self.classes = np.full(at.shape, _NONE, np.uint8)
        self.classes[inside] = CLASS[data[at[inside]]]
        self.state, self.ends, self.marks = _scan(self.classes)

    def function(self, text: int) -> tuple[list[int], list[int], list[int]]:
        """The text's own exit states, word ends and markers, for each entry state."""
        a, b = self.by_text[text], self.by_text[text + 1]
        f, ends, marks = self.state[a:b].astype(np.int64), self.ends[a:b], self.marks[a:b]
        while len(f) > 1:
            if len(f) % 2:
                f, ends, marks = np.vstack([f, np.arange(STATES)[None]]), np.vstack([ends, np.zeros((1, STATES), np.int64)]), np.vstack([marks, np.zeros((1, STATES), np.int64)])
            left, right = f[::2], f[1::2]
            ends = ends[::2] + np.take_along_axis(ends[1::2], left, axis=1)
            marks = marks[::2] + np.take_along_axis(marks[1::2], left, axis=1)
            f = np.take_along_axis(right, left, axis=1)
        if not len(f):
            return list(range(STATES)), [0] * STATES, [0] * STATES
        return f[0].tolist(), ends[0].tolist(), marks[0].tolist()

    def resolve(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ends, markers and exit state of each text that is entered at its start; keeps what ``select`` needs."""
        first = self.by_text[:-1][self.n_blocks > 0]
        self.entry = _entries(self.state, first)
        rows = np.arange(len(self.entry))
        self.upto = np.concatenate([[0], np.cumsum(self.ends[rows, self.entry])])
        marks = np.concatenate([[0], np.cumsum(self.marks[rows, self.entry])])
        last = np.full(len(self.n_blocks), SPACE, np.int8)
        full = self.n_blocks > 0
        at = self.by_text[1:][full] - 1
        last[full] = self.state[at, self.entry[at]]
        return self.upto[self.by_text[1:]] - self.upto[self.by_text[:-1]], marks[self.by_text[1:]] - marks[self.by_text[:-1]], last

    def select(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Byte offset in each of ``text`` after its ``k``-th word: that of the space that ends it, or of the text's end."""
        wanted = self.upto[self.by_text[text]] + k
        block = np.searchsorted(self.upto, wanted, "left") - 1
        out = self.offsets[text + 1] - self.offsets[text]
        there = (k > 0) & (block < self.by_text[text + 1])
        which, block, left = np.flatnonzero(there), block[there], (wanted - self.upto[np.clip(block, 0, None)])[there]
        state = self.entry[block].astype(np.int64)
        for i in range(BLOCK):
            c = self.classes[block, i]
            left = left - WORD_END[c, state]
            hit = (left == 0) & (WORD_END[c, state] > 0)
            out[which[hit]] = self.start[block[hit]] + i - self.offsets[text[which[hit]]]
            state = NEXT[c, state].astype(np.int64)
        out[k <= 0] = 0
        return out


CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "n_marks", "first_cut", "second_cut")])


def _draws() -> list[Column]:
    """h1 to h4 of the rule: 8 digits each of a digest of the id. A null id is drawn as an empty one."""
    digest = F.sha2(F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and cuts, in code points, of texts that fit a batch, added to their rows."""
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = utf8(batch.column("text"))
            scan = Scan(data, offsets)
            ends, marks, last = scan.resolve()
            size = np.diff(offsets)
            n = ends + (size > 0)  # the last token ends with the text, be it a word or space
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            text = np.arange(len(size))
            draws = np.stack([batch.column(h).to_numpy() for h in ("h1", "h2")]) % (n + 1)
            cuts = []
            for k in (draws.min(0), draws.max(0)):
                at = np.where(k == n, size, scan.select(text, k))
                cuts.append(points[offsets[:-1] + at] - points[offsets[:-1]])
            made = [pa.array(x.astype(np.int64)) for x in (n, marks, *cuts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *CUTS.names])


def _pieces(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Long texts as pieces of whole code points."""
    for batch in batches:
        for row in range(len(batch)):
            data, _ = utf8(batch.column("text").slice(row, 1))
            at, no = 0, 0
            while at < len(data):
                to = min(at + piece_bytes, len(data))
                while to < len(data) and (data[to] & 0xC0) == 0x80:
                    to += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, 1), batch.column("text_hash").slice(row, 1), pa.array([no], pa.int64()), pa.array([data[at:to].tobytes()], pa.binary())],
                    ["doc_id", "text_hash", "no", "piece"],
                )
                at, no = to, no + 1


FUNCTION = "state array<bigint>, ends array<bigint>, marks array<bigint>, chars bigint"


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("piece").cast(pa.string()))
        scan = Scan(data, offsets)
        f = [scan.function(i) for i in range(len(batch))]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        made = [pa.array([x[j] for x in f], pa.list_(pa.int64())) for j in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text_hash", "no")] + made + [pa.array(points[offsets[1:]] - points[offsets[:-1]])], ["doc_id", "text_hash", "no", "state", "ends", "marks", "chars"])


def _compose(ordered: Column) -> Column:
    """The composition of an array of functions in their order."""
    zero = F.array(*[F.lit(0).cast("long")] * STATES)
    start = F.struct(F.array(*[F.lit(s).cast("long") for s in range(STATES)]).alias("state"), zero.alias("ends"), zero.alias("marks"), F.lit(0).cast("long").alias("chars"))

    def then(a: Column, b: Column) -> Column:
        through = lambda c: F.transform(a["state"], lambda s: F.get(b[c], s.cast("int")))
        summed = lambda c: F.zip_with(a[c], through(c), lambda x, y: x + y)
        return F.struct(through("state").alias("state"), summed("ends").alias("ends"), summed("marks").alias("marks"), (a["chars"] + b["chars"]).alias("chars"))

    return F.aggregate(ordered, start, then)


def _composed(functions: DataFrame, by: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("no", "state", "ends", "marks", "chars")))
    return functions.groupBy(*by).agg(_compose(parts).alias("f")).select(*by, "f.*")


def long_cuts(texts: DataFrame, piece_bytes: int = LONG, fan_in: int = FAN_IN) -> DataFrame:
    """n, n_marks and cuts of each (doc_id, text_hash) of long ``texts``, whose pieces are scanned in parallel.

    Two levels of composition, of ``fan_in`` functions a group: a text of 2 GB, the most a row can hold, has 32,768
    pieces of 64 KiB."""
    key = ["doc_id", "text_hash"]
    ship(texts.sparkSession)
    dealt = texts.select(*key, "text").mapInArrow(lambda batches: _pieces(batches, piece_bytes), "doc_id bigint, text_hash bigint, no bigint, piece binary")
    pieces = stored(dealt, "pieces")
    functions = stored(pieces.repartition("text_hash", "no").mapInArrow(_functions, f"doc_id bigint, text_hash bigint, no bigint, {FUNCTION}"), "functions")
    # repeated rows made the same pieces
    functions = functions.dropDuplicates([*key, "no"]).withColumn("part", F.floor(F.col("no") / fan_in))
    parts = _composed(functions, [*key, "part"]).withColumnRenamed("part", "no")
    whole = _composed(parts, key)
    n = F.get("ends", F.lit(SPACE)) + 1  # a long text has a last token
    draws = _draws()
    cut = [F.pmod(h, F.col("n") + 1) for h in draws[:2]]
    plan = whole.select(*key, n.alias("n"), F.get("marks", F.lit(SPACE)).alias("n_marks"), F.col("chars").alias("all_chars"))
    plan = plan.withColumns({"k1": F.least(*cut), "k2": F.greatest(*cut)})
    # running compositions: over the parts, then over the pieces of a part
    over = lambda *by: Window.partitionBy(*by).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    entering = lambda w, s: _compose(F.coalesce(F.array_sort(F.collect_list(F.struct("no", "state", "ends", "marks", "chars")).over(w)), F.array().cast(s)))
    kind = "array<struct<no:bigint,state:array<bigint>,ends:array<bigint>,marks:array<bigint>,chars:bigint>>"
    into_part = parts.select(*key, F.col("no").alias("part"), entering(over(*key), kind).alias("p"))
    into_piece = functions.withColumn("q", entering(over(*key, "part"), kind))
    both = into_piece.join(into_part, (into_piece["text_hash"] == into_part["text_hash"]) & into_piece["doc_id"].eqNullSafe(into_part["doc_id"]) & (into_piece["part"] == into_part["part"]))
    both = both.select(into_piece["doc_id"], into_piece["text_hash"], into_piece["no"], "state", "ends", F.col("p").alias("p"), F.col("q").alias("q"))
    mid = F.get("p.state", F.lit(SPACE)).cast("int")
    entry = F.get("q.state", mid).cast("int")
    before = F.get("p.ends", F.lit(SPACE)) + F.get("q.ends", mid)
    places = both.select(*key, "no", entry.alias("entry"), before.alias("before"), (before + F.get("ends", entry)).alias("after"), (F.col("p.chars") + F.col("q.chars")).alias("chars_before"))
    same = lambda a, b: (a["text_hash"] == b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    wanted = plan.select(*key, F.explode(F.array_distinct(F.array("k1", "k2"))).alias("k"), "n").where("k > 0 and k < n")
    held = places.join(wanted, same(places, wanted) & (places["before"] < wanted["k"]) & (wanted["k"] <= places["after"])).select(places["doc_id"], places["text_hash"], "no", "entry", (F.col("k") - F.col("before")).alias("left"), "k", "chars_before")
    held = stored(held, "held")
    cut_at = pieces.dropDuplicates([*key, "no"]).join(held, same(pieces, held) & (pieces["no"] == held["no"])).select(held["doc_id"], held["text_hash"], "entry", "left", "k", "chars_before", "piece").mapInArrow(_find, "doc_id bigint, text_hash bigint, k bigint, cut bigint")
    at = F.map_from_entries(F.collect_list(F.struct("k", "cut")))
    found = cut_at.groupBy(*key).agg(at.alias("cuts"))
    place = lambda k: F.when(F.col(k) <= 0, 0).when(F.col(k) >= F.col("n"), F.col("all_chars")).otherwise(F.try_element_at("cuts", F.col(k)))
    done = plan.join(found, same(plan, found), "left").select(plan["doc_id"], plan["text_hash"], "n", "n_marks", place("k1").cast("long").alias("first_cut"), place("k2").cast("long").alias("second_cut"))
    return stored(done, "cuts")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cut of each piece: after its ``left``-th word end, counted from entry state ``entry``."""
    for batch in batches:
        cuts = []
        for row in range(len(batch)):
            data, offsets = utf8(batch.column("piece").slice(row, 1).cast(pa.string()))
            entry, left = batch.column("entry")[row].as_py(), batch.column("left")[row].as_py()
            scan = Scan(data, offsets)
            scan.resolve()
            # the piece's own states after its first byte are those of any entry; only a word that ended before differs
            early = int(entry != SPACE and len(data) > 0 and not IN_WORD[data[0]])
            at = 0 if early and left == 1 else int(scan.select(np.zeros(1, np.int64), np.array([left - early]))[0])
            cuts.append(batch.column("chars_before")[row].as_py() + int(((data[:at] & 0xC0) != 0x80).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("k"), pa.array(cuts, pa.int64())], ["doc_id", "text_hash", "k", "cut"])


def transform(docs: DataFrame, fim_percent: int = 50, spm_percent: int = 80, long_bytes: int = LONG, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, text, n (tokens), form, prefix_chars, middle_chars and output for each row of ``docs``.

    The prefix ends after the smaller of two draws of tokens, the middle after the larger. ``fim_percent`` of the
    documents are transformed, ``spm_percent`` of these with the suffix first. Texts of over ``long_bytes`` are scanned
    in pieces of as many. Empty texts and texts that hold a
    marker are plain. A null text is empty; a null id draws as an empty one; repeated rows have equal results and
    all stay; other columns of ``docs`` are left out. No rows, no result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = _draws()
    ship(docs.sparkSession)
    short = rows.where(F.octet_length("text") <= long_bytes).withColumns({"h1": h1, "h2": h2})
    cut_short = short.mapInArrow(_cut_batches, T.StructType([*short.schema.fields, *CUTS.fields])).drop("h1", "h2")
    long = rows.where(F.octet_length("text") > long_bytes).withColumn("text_hash", text_key(F.col("text")))
    cuts = long_cuts(long, long_bytes, fan_in)
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *CUTS.names)
    cut_long = long.join(cuts, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", *CUTS.names)
    every = cut_short.unionByName(cut_long)
    form = F.when((F.col("text") == "") | (F.col("n_marks") > 0) | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    every = every.withColumn("form", form)
    one, two = F.col("first_cut").cast("int"), F.col("second_cut").cast("int")
    prefix, middle = F.substring("text", 1, one), F.substring("text", one + 1, two - one)
    suffix = F.substring("text", two + 1, F.length("text"))
    mark = {k: F.lit(v) for k, v in MARKS.items()}
    output = F.when(F.col("form") == "psm", F.concat(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle)).when(F.col("form") == "spm", F.concat(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return every.select("doc_id", "text", "n", "form", F.when(cut, F.col("first_cut")).alias("prefix_chars"), F.when(cut, F.col("second_cut") - F.col("first_cut")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text that an output of ``form`` was made from: cut texts hold no markers, so these divide it."""
    part = F.split(output, "|".join(MARKS.values()), -1)
    text = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)
