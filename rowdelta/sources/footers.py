"""Parquet footers as tables: executors read those of all files, and what they declare is merged.

Executors open files by their own libraries where the scheme allows it (``OPEN``). Footers of other file systems are
read by the driver through Hadoop, one after the other.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.model import FieldInfo, SchemaInfo
from rowdelta.workers import ship

from .hadoop import HadoopFile, data_files

#: Schemes that workers open themselves, and under which name.
OPEN = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Footers that a task reads.
EACH = 64
#: Distinct schemas of a table's files that the driver merges.
MOST_SCHEMAS = 10_000

FOOTER = pa.schema(
    [
        ("file", pa.string()),
        ("bytes", pa.int64()),
        ("rows", pa.int64()),
        ("row_groups", pa.int64()),
        ("columns", pa.int64()),
        ("created_by", pa.string()),
        ("declared", pa.binary()),
        ("metadata", pa.map_(pa.string(), pa.string())),
    ]
)
GROUP = pa.schema(
    [
        ("file", pa.string()),
        ("row_group", pa.int64()),
        ("group_rows", pa.int64()),
        ("column", pa.string()),
        ("type", pa.string()),
        ("n_values", pa.int64()),
        ("nulls", pa.int64()),
        ("least", pa.string()),
        ("greatest", pa.string()),
        ("compression", pa.string()),
        ("compressed", pa.int64()),
        ("uncompressed", pa.int64()),
    ]
)
_FOOTER_SQL = "file string, bytes bigint, rows bigint, row_groups bigint, columns bigint, created_by string, declared binary, metadata map<string,string>"
_GROUP_SQL = "file string, row_group bigint, group_rows bigint, column string, type string, n_values bigint, nulls bigint, least string, greatest string, compression string, compressed bigint, uncompressed bigint"


def _footer_rows(file: str, size: int, meta: pq.FileMetaData) -> list[dict]:
    own = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}
    plain = meta.schema.to_arrow_schema().remove_metadata()
    return [{"file": file, "bytes": size, "rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": meta.num_columns, "created_by": meta.created_by, "declared": plain.serialize().to_pybytes(), "metadata": list(own.items())}]


def _group_rows(file: str, size: int, meta: pq.FileMetaData) -> list[dict]:
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            part = group.column(c)
            s = part.statistics if part.is_stats_set else None
            bound = lambda v: None if v is None else v.hex() if isinstance(v, bytes) else str(v)
            ends = (bound(s.min), bound(s.max)) if s is not None and s.has_min_max else (None, None)
            out.append(
                {
                    "file": file,
                    "row_group": g,
                    "group_rows": group.num_rows,
                    "column": part.path_in_schema,
                    "type": part.physical_type,
                    "n_values": part.num_values,
                    "nulls": s.null_count if s is not None and s.has_null_count else None,
                    "least": ends[0],
                    "greatest": ends[1],
                    "compression": part.compression,
                    "compressed": part.total_compressed_size,
                    "uncompressed": part.total_uncompressed_size,
                }
            )
    return out


def _opened(file: str) -> pq.FileMetaData:
    scheme, _, rest = file.partition(":")
    with_fs, path = pafs.FileSystem.from_uri(f"{OPEN[scheme]}://{rest if rest.startswith('//') else '//' + rest}".replace("////", "//"))
    with with_fs.open_input_file(path) as f:
        return pq.read_metadata(f)


def read_footer(spark: SparkSession, file: str) -> pq.FileMetaData:
    """One file's footer, read by the driver."""
    if file.partition(":")[0] in OPEN:
        return _opened(file)
    with HadoopFile(spark, file) as held:
        return pq.read_metadata(pa.PythonFile(io.BufferedReader(held, 1 << 16)))


def _table(spark: SparkSession, path: str, rows_of: Callable[[str, int, pq.FileMetaData], list[dict]], schema: pa.Schema, sql: str) -> DataFrame:
    files = [(f, n) for f, n in data_files(spark, path) if n > 0]
    if not all(f.partition(":")[0] in OPEN for f, _ in files):
        rows = []
        for f, n in files:
            rows += rows_of(f, n, read_footer(spark, f))
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema)) if rows else spark.createDataFrame([], sql)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(rows_of(f, n, _opened(f)), schema)

    listed = ship(spark).createDataFrame(files, "path string, length bigint")
    return listed.repartition(max(1, math.ceil(len(files) / EACH))).mapInArrow(read, sql)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each Parquet file of ``path``, a file or folder: rows, row groups, leaf columns, who wrote it, its Arrow
    schema (``declared``, without metadata) and its key-value metadata. Empty files have no footer and no row."""
    return _table(spark, path, _footer_rows, FOOTER, _FOOTER_SQL)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """A row for each leaf column of each row group of each Parquet file of ``path``.

    least and greatest are the statistics as text, bytes as hex; they and nulls are null where a file has none."""
    return _table(spark, path, _group_rows, GROUP, _GROUP_SQL)


def columns_of(found: DataFrame) -> DataFrame:
    """(file, place, column, type, nullable) of each top-level column of each of ``footers``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, raw in zip(batch.column("file").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                schema = pa.ipc.read_schema(pa.py_buffer(raw))
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([f] * len(schema), pa.string()),
                        "place": pa.array(range(len(schema)), pa.int64()),
                        "column": pa.array(schema.names, pa.string()),
                        "type": pa.array([str(x.type) for x in schema], pa.string()),
                        "nullable": pa.array([x.nullable for x in schema], pa.bool_()),
                    }
                )

    return found.select("file", "declared").mapInArrow(rows, "file string, place bigint, column string, type string, nullable boolean")


def disagreements(found: DataFrame) -> DataFrame:
    """(column, fact, value, n_files, example) wherever files of ``footers`` declare a column differently.

    fact is type, nullable or missing; example is the first such file by name. Files that agree give no rows."""
    each = columns_of(found)
    facts = each.select("column", "file", F.explode(F.create_map(F.lit("type"), F.col("type"), F.lit("nullable"), F.col("nullable").cast("string"))).alias("fact", "value"))
    several = facts.groupBy("column", "fact").agg(F.count_distinct("value").alias("n")).where("n > 1")
    differ = facts.join(several, ["column", "fact"]).groupBy("column", "fact", "value").agg(F.count(F.lit(1)).alias("n_files"), F.min("file").alias("example"))
    names = [r[0] for r in each.select("column").distinct().collect()]
    own = each.groupBy("file").agg(F.collect_set("column").alias("own"))
    absent = own.select("file", F.explode(F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), "own")).alias("column"))
    absent = absent.groupBy("column").agg(F.count(F.lit(1)).alias("n_files"), F.min("file").alias("example"))
    return differ.select("column", "fact", "value", "n_files", "example").unionByName(absent.select("column", F.lit("missing").alias("fact"), F.lit(None).cast("string").alias("value"), "n_files", "example"))


def merged_schema(found: DataFrame) -> SchemaInfo:
    """What all of ``footers`` declare together: columns in the order they appear, nullable where any file says so or
    lacks the column; metadata that no two files contradict. Types that differ are an error that names a file of each."""
    schemas = found.groupBy("declared").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n")).orderBy("file").limit(MOST_SCHEMAS + 1).collect()
    if len(schemas) > MOST_SCHEMAS:
        raise ValueError(f"files have over {MOST_SCHEMAS} schemas")
    fields: dict[str, tuple[pa.DataType, bool, str, int]] = {}
    total = 0
    for r in schemas:
        total += r["n"]
        for f in pa.ipc.read_schema(pa.py_buffer(bytes(r["declared"]))):
            kind, nullable, file, n = fields.get(f.name, (f.type, False, r["file"], 0))
            if kind != f.type:
                raise TypeError(f"column {f.name} is {kind} in {file} and {f.type} in {r['file']}")
            fields[f.name] = (kind, nullable or f.nullable, file, n + r["n"])
    keys = found.select(F.explode("metadata").alias("key", "value")).groupBy("key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").collect()
    metadata = {r["key"].encode(): r["value"].encode() for r in keys}
    made = pa.schema([pa.field(n, kind, nullable or seen < total) for n, (kind, nullable, _, seen) in fields.items()])
    return SchemaInfo(tuple(FieldInfo(f.name, f.type, f.nullable) for f in made), SchemaInfo.of(made.with_metadata(metadata)).metadata)
