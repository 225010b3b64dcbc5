"""What the operators share: table access, sizes, and tables kept in the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowdelta.workers import shared_dir

#: ``[\x20\x09-\x0D]``: what separates words, and what is stripped from line ends.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage at files that outlive executors, and later uses read instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowdelta/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = written(spark, df.schema, path)
    if (inner := _SCRATCH.get()) is not None:
        inner.append(path)
    return out


def written(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The table at ``path``, which :func:`forget` deletes."""
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


#: What the innermost ``scratch`` of this thread deletes.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` or :func:`written` that nothing will read any more."""
    _delete(df.sparkSession, df._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at its end what this thread stored inside: results have to be written before."""
    own: list[str] = []
    token = _SCRATCH.set(own)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in own:
            _delete(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` scans, as the optimizer estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, chunk_bytes: int, least: int) -> int:
    """How many chunks of about ``chunk_bytes`` of input there are, at least ``least``."""
    size = input_bytes(df)
    return max(least, -(-size // chunk_bytes)) if size < 1 << 60 else least


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other letter changes."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """Tells rows with one doc_id but other texts apart."""
    return F.xxhash64(text)
