"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item occurs in a document only if all its word shingles do, so one of them is enough to find
candidates: the prefix of a window is its rarest shingle, by number of places in the benchmark and then by
hash. Document shingles join these prefix tokens, the token's offset gives the only possible place of the
window, places outside the document are dropped, and what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_key

#: Prefix rows are broadcast up to this many (counted first). Beyond, only their tokens are, up to MOST_TOKENS of 64
#: bits: document shingles that are no token stay where they are, the few others meet the rows in a shuffle join.
BROADCAST_ROWS, MOST_TOKENS = 200_000, 4_000_000


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and all characters beyond ASCII, A-Z lower-cased. Null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _shingles(hashes: str, k: Column | int) -> Column:
    """Hashes of all runs of k word hashes."""
    return F.expr(f"if(size({hashes}) >= {k}, transform(sequence(0, size({hashes}) - {k}), i -> xxhash64(slice({hashes}, i + 1, {k}))), cast(array() as array<bigint>))")


def windows(items: DataFrame, window: int = 13) -> DataFrame:
    """(item_id, name, words): each distinct window of each item; name is its words with one space between."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = words.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("words"))
    return cut.withColumn("name", F.array_join("words", " ")).dropDuplicates(["item_id", "name"])


def prefix_tokens(items: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """(k, token, offset, size, name): the rarest shingle of each window and where in the window it is.

    Windows of fewer than k words are one shingle."""
    named = windows(items, window).dropDuplicates(["name"]).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    named = named.withColumn("k", F.least(F.lit(k), F.size("words")))
    tokens = named.select("name", "k", F.size("words").alias("size"), F.posexplode(_shingles("hashes", "k")).alias("offset", "token"))
    # each place in the benchmark once: windows overlap, so count the shingles of whole items
    whole = items.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    whole = whole.withColumn("k", F.least(F.lit(k), F.size("hashes"))).where("k > 0")
    seen = whole.select("k", F.explode(_shingles("hashes", "k")).alias("token")).groupBy("k", "token").agg(F.count("*").alias("places"))
    ranked = tokens.join(seen, ["k", "token"]).groupBy("name", "k", "size").agg(F.min(F.struct("places", "token", "offset")).alias("least"))
    return ranked.select("k", "least.token", "least.offset", "size", "name")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _candidates(shingles: DataFrame, prefix: DataFrame) -> DataFrame:
    """Document shingles with the prefix rows of their token."""
    rows = prefix.count()
    if rows <= BROADCAST_ROWS:
        return shingles.join(F.broadcast(prefix), ["k", "token"])
    tokens = prefix.select("token").distinct()
    few = shingles.join(F.broadcast(tokens), "token", "left_semi") if rows <= MOST_TOKENS else shingles
    return few.join(prefix, ["k", "token"])


def overlaps(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids) for each row of ``docs`` (doc_id, text).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    A document word is hit if it is inside any occurrence of a window; item_ids are the items with occurring
    windows, as strings in string order.

    Null and empty texts have no words. Items with a null id hit words but are not listed. Rows are judged
    by their own text whatever their doc_id, also null; equal rows get equal results. Either table may be
    empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_key(F.col("text")).alias("text_hash"))
    items = items.select("item_id", "text")
    prefix = stored(prefix_tokens(items, window, k), "prefix")
    sizes = sorted(r["k"] for r in prefix.select("k").distinct().collect())  # at most k values
    found = None
    if sizes:
        # shingles of all lengths in one pass over the words
        own = docs.select("doc_id", "text_hash", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
        shingles = [F.transform(_shingles("hashes", size), lambda t, i: F.struct(F.lit(size).alias("k"), i.alias("pos"), t.alias("token"))) for size in sizes]  # noqa: B023
        own = own.select("doc_id", "text_hash", F.size("hashes").alias("n"), F.explode(F.concat(*shingles)).alias("s")).select("doc_id", "text_hash", "n", "s.*")
        placed = _candidates(own, prefix).withColumn("start", F.col("pos") - F.col("offset"))
        found = placed.where("start >= 0 and start + size <= n").select("doc_id", "text_hash", "start", "size", "name")
    words = docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("w"))
    if found is None:
        return words.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("item_ids"))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("start", "size", "name")).alias("maybe"))
    texts = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text_hash", "maybe", words_of(F.col("text")).alias("w"))
    texts = texts.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.expr("filter(maybe, c -> array_join(slice(w, c.start + 1, c.size), ' ') = c.name)").alias("hits"))
    hit = F.expr("size(array_distinct(flatten(transform(hits, c -> sequence(c.start, c.start + c.size - 1)))))")
    judged = stored(texts.select("doc_id", "text_hash", "n_words", F.when(F.size("hits") > 0, hit).otherwise(0).cast("long").alias("n_hit"), F.expr("array_distinct(transform(hits, c -> c.name))").alias("names")), "judged")
    owners = windows(items, window).select(F.col("item_id").cast("string").alias("item_id"), "name")
    listed = judged.where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.explode("names").alias("name")).join(_small(owners), "name")
    listed = listed.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = judged.join(listed, judged["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """A twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
