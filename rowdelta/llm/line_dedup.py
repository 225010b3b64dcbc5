"""Corpus-wide line deduplication that returns keep bitmaps, in DataFrame functions only.

Every line of enough characters becomes a row of hashes, document and position. The rows are range-partitioned
by hash with a secondary sort by document (largest first) and position, so that one pass over a partition sees
a line's first occurrence, its document count and everything to drop. Lines so common that they would crowd a
partition are counted by partial aggregation and meet their rows in a join, by broadcast while they are few.
What comes back per document is a bitmap of kept lines, compressed to the 64-line words that drop something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, stored, text_key

#: A line is hot if it has over 1 / HOT of all rows (but 100 at least), or over HOT_ROWS: no task sees more rows of a line.
HOT = 1000
HOT_ROWS = 10_000
#: Hot lines are broadcast up to this many and joined by a shuffle beyond; a hot key of such a join is split at run time.
BROADCAST_LINES = 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, keep) of each document that loses lines.

    keep is an array of (word, bits), ascending: bit b of a word is 1 if line 64 * word + b stays. Lines of
    words that are absent stay.
    """
    # a generator's output is made once a document, where a column beside posexplode would be made again for each line
    once = F.array(F.struct(text_key(F.col("text")).alias("text_hash"), F.transform(lines_of(F.col("text")), line_key).alias("keys")))
    keyed = docs.select("doc_id", F.inline(once)).select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key"))
    keyed = keyed.where(F.length("key") >= min_chars)
    rows = stored(keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("#"), "key").alias("g"), "doc_id", "pos", "text_hash"), "lines")
    total = rows.count()
    bound = min(max(total // HOT, 100), HOT_ROWS)
    hot = stored(rows.groupBy("h", "g").count().where(F.col("count") > bound).select("h", "g"), "hot")
    small = F.broadcast if hot.count() <= BROADCAST_LINES else lambda df: df

    held = rows.join(small(hot), ["h", "g"]).select("h", "g", "doc_id").distinct()
    last = held.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    hot_drops = rows.join(small(last.select("h", "g", "last")), ["h", "g"]).where("doc_id is null or doc_id < last")

    by_line = Window.partitionBy("h", "g")
    stream = by_line.orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    cold = rows.join(small(hot), ["h", "g"], "left_anti").repartitionByRange("h", "g")
    cold = cold.withColumn("opens", ((F.row_number().over(stream) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream))).cast("int"))
    cold = cold.withColumn("last", F.first("doc_id").over(stream)).withColumn("n", F.sum("opens").over(by_line))
    cold_drops = cold.where((F.col("n") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))

    drops = hot_drops.select("doc_id", "text_hash", "pos").unionByName(cold_drops.select("doc_id", "text_hash", "pos"))
    words = drops.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``docs`` with n_lines, n_dropped and kept_text.

    A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in
    the largest doc_id holding it. Other lines stay, joined by newlines.

    A null or empty text is one empty line. Rows with one doc_id count as one document, and a null doc_id as
    the smallest; equal rows get equal results. An empty table gives an empty result. Columns of ``docs`` with any
    names come back as they are, but for those named like the three new ones, which are replaced.
    """
    keep = keep_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), min_chars, min_docs)
    # words that drop nothing are filled in, so that a line finds its word by place
    gap = "keep[k].word - if(k = 0, 0, keep[k - 1].word + 1)"
    keep = keep.select("doc_id", "text_hash", F.expr(f"flatten(transform(sequence(0, size(keep) - 1), k -> array_append(array_repeat(-1L, {gap}), keep[k].bits)))").alias("keep"))
    # all columns of docs in one, so that none can clash with those made here
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("hash"))
    both = rows.join(keep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    stays = F.expr("filter(lines, (l, i) -> coalesce(getbit(get(keep, int(i div 64)), i % 64) = 1, true))")
    both = both.select("row", "keep", lines_of(F.col("row.text")).alias("lines"))
    both = both.select("row", "lines", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(stays).alias("kept"))
    n = F.size("lines").cast("long")
    new = {"n_lines": n, "n_dropped": n - F.size("kept"), "kept_text": F.array_join("kept", "\n")}
    return both.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *(c.alias(k) for k, c in new.items()))
