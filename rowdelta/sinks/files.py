"""Files made by workers as bytes and written by Spark's own writers.

Formats that Spark cannot write, or not with what belongs in a file's footer, are made in memory by Arrow, a file a row.
Spark's text writer puts a row's bytes and a line separator into a file: with one row a file, and a format's closing
bytes as the separator, that is the file. So it is written to any file system Spark knows, under Spark's commit protocol:
attempts of a task write apart, and an overwrite replaces what was there.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rowdelta.sources.hadoop import data_files, file_system
from rowdelta.workers import ship

#: Bytes of rows in memory beyond which a file is closed.
FILE_BYTES = 64 << 20


def arrow_schema_of(df: DataFrame, metadata: dict[str, str] | None = None) -> pa.Schema:
    """The Arrow schema of ``df``; metadata of its columns, and ``metadata``, become that of the schema."""
    return with_metadata(to_arrow_schema(df.schema), df.schema, metadata)


def with_metadata(schema: pa.Schema, declared: StructType, metadata: dict[str, str] | None = None) -> pa.Schema:
    found = {k: str(v) for f in declared.fields for k, v in (f.metadata or {}).items()} | (metadata or {})
    return schema.with_metadata(found) if found else schema


def _parquet(out: io.BytesIO, schema: pa.Schema):
    return pq.ParquetWriter(out, schema, compression="snappy", use_dictionary=False)


def _ipc(out: io.BytesIO, schema: pa.Schema):
    return ipc.new_file(out, schema)


#: What makes a file, its closing bytes and its suffix.
FORMATS: dict[str, tuple[Callable, bytes, str]] = {"parquet": (_parquet, b"PAR1", ".parquet"), "arrow": (_ipc, b"ARROW1", ".arrow")}


class _Open:
    """A file being made."""

    def __init__(self, make: Callable, schema: pa.Schema):
        self.out, self.held = io.BytesIO(), 0
        self.writer, self.schema = make(self.out, schema), schema

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.schema, strict=True)], schema=self.schema))
        self.held += batch.nbytes

    def closed(self, end: bytes) -> bytes:
        self.writer.close()
        whole = self.out.getvalue()
        assert whole.endswith(end)
        return whole[: -len(end)]


def write_files(df: DataFrame, path: str, kind: str, metadata: dict[str, str] | None = None, partition: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """``df`` as a folder of ``kind`` files, each with the schema's metadata; replaces what is at ``path``.

    With ``partition``, a column of strings, there is a folder for each of its values and the column is in their names.
    No rows give one file without any. A task holds a file of about ``file_bytes``, one for each value."""
    make, end, suffix = FORMATS[kind]
    spark = ship(df.sparkSession)
    schema = arrow_schema_of(df, metadata)
    if partition:
        schema = schema.remove(schema.get_field_index(partition))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str | None, _Open] = {}

        def row(value: str | None) -> pa.RecordBatch:
            raw = files.pop(value).closed(end)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([value], pa.string())], ["raw", "part"])

        for batch in batches:
            for value, own in _by_value(batch, partition):
                if own.num_rows:
                    if value not in files:
                        files[value] = _Open(make, schema)
                    files[value].add(own)
                    if files[value].held >= file_bytes:
                        yield row(value)
        for value in list(files):
            yield row(value)

    blobs = df.mapInArrow(made, "raw binary, part string")
    _write_blobs(blobs, path, end, partition)
    _, fs = file_system(spark, path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    made_files = data_files(spark, path)
    if not any(size for _, size in made_files):
        empty = _Open(make, schema).closed(end)
        at = f"{path.rstrip('/')}/{partition}=none" if partition else path
        _write_blobs(spark.createDataFrame([(empty, None)], "raw binary, part string").coalesce(1), at, end, None)
        made_files = data_files(spark, path)
    for name, size in made_files:
        if not size:  # of a task without rows
            fs.delete(hadoop_path(name), False)
        elif name.endswith(".txt"):
            fs.rename(hadoop_path(name), hadoop_path(name.removesuffix(".txt") + suffix))


def _by_value(batch: pa.RecordBatch, partition: str | None) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    if partition is None:
        yield None, batch
        return
    at = batch.schema.get_field_index(partition)
    values = batch.column(at)
    others = [i for i in range(batch.num_columns) if i != at]
    for value in values.unique().to_pylist():
        own = pc.is_null(values) if value is None else pc.fill_null(pc.equal(values, value), False)
        part = batch.filter(own)
        yield value, pa.RecordBatch.from_arrays([part.column(i) for i in others], [batch.schema.names[i] for i in others])


def _write_blobs(blobs: DataFrame, path: str, end: bytes, partition: str | None) -> None:
    rows = blobs.select(F.col("raw").cast("string").alias("value"), *([F.col("part").alias(partition)] if partition else []))
    writer = rows.write.mode("overwrite").option("lineSep", end.decode()).option("maxRecordsPerFile", 1)
    (writer.partitionBy(partition) if partition else writer).text(path)
