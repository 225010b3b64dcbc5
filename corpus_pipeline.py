"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. language_id drops documents without a recognised language.
2. line_dedup drops lines repeated across documents from all but one of them.
3. simhash_dedup keeps one document of each group of near duplicates.
4. decontamination drops documents that hold benchmark passages.
5. mixing takes each source's documents to meet the target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.llm import decontamination, language_id, line_dedup, mixing, simhash
from rowdelta.llm.common import forget, scratch, shared_dir, table, text_key, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if its language's calibrated probability is this, or this many times that of even odds.
ENOUGH, LEAST_LIFT = 0.4, 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. ``lang`` stays as it was given.

    Null texts, texts without letters and those that fit no learned language better than the others go. Rows are
    judged one by one, also repeated ones; null ids and sources are no reason to go. No rows, no result."""
    known = language_id.identify(docs.select(*COLUMNS))
    fits = (F.col("score") >= ENOUGH) | (F.col("lift") >= LEAST_LIFT)
    return known.where((F.col("lang_pred") != language_id.UNKNOWN) & fits).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines; n_chars is that of the new text.

    A null text stays null. Repeated rows stay, each with the same text. No rows, no result."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group; a null doc_id only where a group has no other.

    Rows that repeat a doc_id and text are one document, with the least of their lang, source and n_chars. Null and
    empty texts are a group. No rows, no result."""
    first = simhash.near_duplicates(docs).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("x"))
    none = F.lit(None)
    first = first.select("x.doc_id", "x.text_hash", none.cast("string").alias("text"), none.cast(REST).alias("rest"), F.lit(1).alias("kept"))
    # one shuffle of the texts: rows of a document and its mark meet in an aggregate
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), "text", F.struct("lang", "source", "n_chars").alias("rest"), F.lit(0).alias("kept"))
    found = rows.unionByName(first).groupBy("doc_id", "text_hash").agg(F.max("text").alias("text"), F.min("rest").alias("rest"), F.max("kept").alias("kept"))
    return found.where("kept = 1").select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


REST = "struct<lang:string,source:string,n_chars:bigint>"


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth are in benchmark windows.

    Rows are judged by their own text, repeated ones alike; null and empty texts stay. No rows, no result; with no
    benchmark all stay."""
    docs = docs.select(*COLUMNS)
    judged = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"))
    bad = judged.where(decontamination.contaminated()).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_hash")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (one to three for each row), size, target and taken words.

    Rows that repeat a doc_id, text and source are one row with the copies of all of them, and the least of their
    lang and n_chars: the taken words of a source are near its target however often rows repeat. A null source is a
    source. No rows, no result."""
    docs = docs.select(*COLUMNS)
    mixed = ("size", "source_size", "target", "copies", "taken")
    taken = mixing.mix(docs)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), "source", "text", F.struct("lang", "n_chars").alias("rest"), *(F.lit(None).cast(taken.schema[c].dataType).alias(c) for c in mixed))
    taken = taken.withColumns({"text": F.lit(None).cast("string"), "rest": F.lit(None).cast("struct<lang:string,n_chars:bigint>")})
    total = [F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken")]
    both = rows.unionByName(taken).groupBy("doc_id", "text_hash", "source").agg(F.max("text").alias("text"), F.min("rest").alias("rest"), *total)
    return both.where("copies > 0").select("doc_id", "text", "rest.lang", "source", "rest.n_chars", *mixed)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Learning, fingerprints and rounding are beyond SQL: tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Only what the last stage returns stays in the shared folder: its table is the result."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/rowdelta/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            forget(before)
        docs = before = written(spark, out.schema, path)
    return docs
