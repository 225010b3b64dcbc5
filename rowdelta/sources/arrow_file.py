"""Arrow IPC files as a Spark source.

Files that the driver and all executors can open are read by record batch, a partition each. Those of other file systems
are read whole by Spark, a file a row, and taken apart by workers: they are to be of moderate size, as sinks write them.
"""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from rowdelta.model import Dataset, SchemaInfo
from rowdelta.schema.types import spark_type
from rowdelta.workers import ship

from .files import local_files
from .hadoop import HadoopFile, data_files

FORMAT = "rowdelta_arrow"


def arrow_schema(path: str, spark: SparkSession | None = None) -> pa.Schema:
    """The schema of a file, or of the first of a folder; without a session only this machine's files are seen."""
    if files := local_files(path, ".arrow"):
        with pa.memory_map(files[0]) as f:
            return ipc.open_file(f).schema
    if spark and (far := _far_files(spark, path)):
        with HadoopFile(spark, far[0]) as held:
            return ipc.open_file(pa.PythonFile(io.BufferedReader(held, 1 << 16))).schema
    raise FileNotFoundError(f"no Arrow file at {path}")


def _far_files(spark: SparkSession, path: str) -> list[str]:
    return [f for f, size in data_files(spark, path) if size and f.endswith(".arrow")]


def to_spark(schema: pa.Schema) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in schema])


class BatchPartition(InputPartition):
    def __init__(self, file: str, batch: int):
        super().__init__((file, batch))
        self.file, self.batch = file, batch


class ArrowFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return to_spark(arrow_schema(self.options["path"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowFileReader(self.options["path"], schema)


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.wanted = path, schema

    def partitions(self) -> list[BatchPartition]:
        out = []
        for file in local_files(self.path, ".arrow"):
            with pa.memory_map(file) as f:
                out += [BatchPartition(file, i) for i in range(ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition: BatchPartition | None):
        if partition is None:  # a file without batches
            return
        with pa.memory_map(partition.file) as f:
            batch = ipc.open_file(f).get_batch(partition.batch)
            wanted = to_arrow_schema(self.wanted)
            columns = [batch.column(i).cast(wanted.field(i).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(g.name, g.type, True) for g in wanted]))


def _read_far(spark: SparkSession, path: str, schema: pa.Schema) -> DataFrame:
    kind = to_spark(schema)
    wanted = to_arrow_schema(kind)
    out = pa.schema([pa.field(g.name, g.type, True) for g in wanted])

    def rows(batches):
        for batch in batches:
            for raw in batch.column("content"):
                held = ipc.open_file(pa.py_buffer(raw.as_buffer()))
                for i in range(held.num_record_batches):
                    own = held.get_batch(i)
                    yield pa.RecordBatch.from_arrays([own.column(k).cast(wanted.field(k).type) for k in range(own.num_columns)], schema=out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").option("recursiveFileLookup", "true").load(path)
    ship(spark)
    return files.select("content").mapInArrow(rows, T.StructType([T.StructField(f.name, f.dataType, True) for f in kind]))


def read_arrow(spark: SparkSession, path: str) -> Dataset:
    """An IPC file, or a folder of them, of any file system."""
    declared = arrow_schema(path, spark)
    info = SchemaInfo.of(declared)
    if not local_files(path, ".arrow"):
        return Dataset(_read_far(spark, path, declared), info)
    ship(spark).dataSource.register(ArrowFileSource)
    return Dataset(spark.read.format(FORMAT).option("path", path).load(), info)
