"""Removal of repeated word windows: Rabin-Karp hashes of every window, matched across the corpus in Spark.

Documents are dealt into chunks by id, text and place in the input, so that no chunk grows with one id or text. A
chunk hashes all its windows and sends each *distinct* hash once, packed, to the hash bucket that owns it, so a
passage found in a third of all documents costs one value per chunk and no bucket or task grows with it. A bucket
finds, for each hash, the first document holding it (by doc_id, then text hash, then chunk) and answers every chunk
with one bit per hash it sent: does an earlier document hold this window?
The chunk then knows for each of its windows whether the word sequence also starts earlier, and merges the
repeated windows into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import input_bytes, parts, spread
from .tokens import WORD_BASE, Words, mix, window_sums

LOWEST = np.iinfo(np.int64).min
RUN = 32


class Chunk:
    """The windows of a chunk's documents, in order of doc_id, text hash and text."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id")
        #: null sorts before every id
        raw = self.ids.combine_chunks()
        raw = raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks)
        null = np.asarray(raw.is_null())
        self.doc_ids = np.where(null, LOWEST, np.asarray(raw.fill_null(0)).astype(np.int64))
        order = np.argsort(self.doc_ids, kind="stable")
        table, self.ids, self.doc_ids = table.take(order), self.ids.take(order), self.doc_ids[order]
        #: orders rows of one id
        self.ties = table.column("tie").to_numpy()
        text = table.column("text").combine_chunks()
        self.words = Words(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
        n = np.maximum(np.diff(self.words.by_doc) - window + 1, 0)
        #: window i starts at word at[i] of the chunk and belongs to document doc[i]
        self.doc = np.repeat(np.arange(len(n)), n)
        first = np.repeat(self.words.by_doc[:-1] - (np.cumsum(n) - n), n)
        self.at = np.arange(n.sum()) + first
        h = self.words.hashes()
        self.hash = mix(window_sums(h, self.at, self.at + window, WORD_BASE))
        self.distinct, self.first, self.which = np.unique(self.hash, return_index=True, return_inverse=True)

    def sent(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``distinct`` ordered by bucket, then document; and where each bucket begins."""
        owner = bucket_of(self.distinct, buckets)
        order = np.lexsort((self.doc[self.first], owner))
        return order, np.searchsorted(owner[order], np.arange(buckets + 1))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def removals(docs: DataFrame, window: int = 20, chunk_bytes: int = 6 << 20, with_text: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, any other columns are ignored) what its repeated windows remove.

    Returns doc_id, n_words, n_removed, kept_sha256, spans (array of [start, end) word ranges, maximal and
    disjoint) and, if asked for, kept_text. A word goes if a window over it has the same words as a window
    that starts earlier: in a smaller doc_id, or in the same document further left. Windows are judged on
    the input.

    Null and empty texts have no words: nothing is removed and the hash is that of the empty string. A null
    doc_id counts as smaller than any id. Rows with one doc_id are documents of their own, in the order of a hash of
    their texts, so that one of equal rows keeps its words. An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a chunk sends a bucket one row; beyond some hundred GB larger chunks keep a row at RUN hashes on average
    most = math.isqrt(input_bytes(docs) * 4 // (15 * RUN))  # about four windows for 15 bytes of Parquet
    chunks = min(spread(docs, chunk_bytes, 2 * parts(spark)), max(most, 2 * parts(spark)))
    buckets = max(parts(spark), chunks // 2)
    # the place in the input keeps equal rows apart; files are split alike when a lost task is run again
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("tie", F.xxhash64("text").bitwiseAND(0xFFFFFFFF))

    def send(table: pa.Table) -> pa.Table:
        c = Chunk(table, window)
        order, cut = c.sent(buckets)
        docs_of = c.doc[c.first]
        rows: dict[str, list] = {"bucket": [], "chunk": [], "hashes": [], "ids": [], "ties": [], "runs": []}
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                held, runs = np.unique(docs_of[own], return_counts=True)
                ids = c.doc_ids[held]
                rows["bucket"].append(b)
                rows["chunk"].append(table.column("chunk")[0].as_py())
                rows["hashes"].append(c.distinct[own].tobytes())
                rows["ids"].append(_pack(np.diff(ids, prepend=np.int64(0))))
                rows["ties"].append(c.ties[held].astype(np.uint32).tobytes())
                rows["runs"].append(_pack(runs.astype(np.uint32)))
        return pa.table(rows, schema=SENT)

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        h = np.concatenate(hashes)
        each = [[_unpack(x, np.int64) for x in table.column("ids").to_pylist()], [np.frombuffer(x, np.uint32) for x in table.column("ties").to_pylist()]]
        ids, ties = np.concatenate([np.cumsum(x) for x in each[0]]), np.concatenate(each[1])
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in each[1]])
        # documents by place: those of one chunk that are alike share theirs
        by = np.lexsort((chunk, ties, ids))
        step = np.ones(len(by), bool)
        step[1:] = (np.diff(ids[by]) != 0) | (np.diff(ties[by].astype(np.int64)) != 0) | (np.diff(chunk[by]) != 0)
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(step)
        ids = np.repeat(place, np.concatenate([_unpack(x, np.uint32) for x in table.column("runs").to_pylist()]))
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        begins = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], begins)
        late = np.empty(len(h), bool)
        late[order] = ids[order] > np.repeat(least, np.diff(begins, append=len(s)))
        ends = np.cumsum([len(x) for x in hashes])
        bits = [np.packbits(late[e - len(x) : e]).tobytes() for e, x in zip(ends, hashes, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())}, schema=ANSWER)

    def settle(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return RESULT.empty_table()
        c = Chunk(docs, window)
        order, cut = c.sent(buckets)
        late = np.zeros(len(c.distinct), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            own = order[cut[b] : cut[b + 1]]
            late[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        #: a window repeats if it is not the chunk's first of its hash, or an earlier document holds it
        again = late[c.which]
        again |= c.first[c.which] != np.arange(len(again))
        step = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(step, c.at[again], 1)
        np.add.at(step, c.at[again] + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        rows: dict[str, list] = {k: [] for k in RESULT.names if k != "doc_id"}
        for d in range(len(c.doc_ids)):
            out = gone[c.words.by_doc[d] : c.words.by_doc[d + 1]]
            kept = c.words.joined(d, ~out)
            edge = np.flatnonzero(np.diff(out, prepend=False, append=False)) if out.any() else np.zeros(0, int)
            rows["n_words"].append(len(out))
            rows["n_removed"].append(int(out.sum()))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["spans"].append(edge.reshape(-1, 2).tolist())
            rows["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
        return pa.table({"doc_id": c.ids, **rows}, schema=RESULT)

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary, ids binary, ties binary, runs binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, bits binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        settle, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept_text string"
    )
    return out if with_text else out.drop("kept_text")


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("ties", pa.binary()), ("runs", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.string())])
