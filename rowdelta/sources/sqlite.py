"""Tables of a SQLite database, a file that the driver and all executors can open, through the library of Python.

Unlike a database in the memory of one process it serves a session on several machines; their folder has to honour locks.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowdelta.model import Dataset
from rowdelta.schema.types import schema_of
from rowdelta.workers import ship

from .files import even_predicates

#: Seconds that a task waits for others to write, and rows that one hands over at a time.
WAIT, ROWS = 3600, 10_000
_KINDS = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "TEXT", T.BinaryType: "BLOB"}
_TYPES = {name: kind for kind, name in _KINDS.items()}


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write_sqlite(df: DataFrame, path: str, table: str, index: str | None = None) -> None:
    """``df`` as a table of a new database. A task's rows are one transaction, kept once however often it is run."""
    path = _local(path)
    for f in df.schema:
        if type(f.dataType) not in _KINDS:
            raise TypeError(f"unsupported type of column {f.name}: {f.dataType.simpleString()}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if os.path.exists(path):
        raise FileExistsError(path)
    name, parts = _quoted(table), _quoted(f"{table}_parts")
    with closing(sqlite3.connect(path)) as db, db:
        db.execute(f"CREATE TABLE {name} ({', '.join(f'{_quoted(f.name)} {_KINDS[type(f.dataType)]}' for f in df.schema)})")
        db.execute(f"CREATE TABLE {parts} (part INTEGER PRIMARY KEY)")
    insert = f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with closing(sqlite3.connect(path, timeout=WAIT, isolation_level=None)) as db:
            db.execute("BEGIN IMMEDIATE")
            again = db.execute(f"INSERT OR IGNORE INTO {parts} VALUES (?)", (TaskContext.get().partitionId(),)).rowcount == 0
            for batch in batches:
                if again:
                    continue
                if any(pa.types.is_floating(c.type) and pc.any(pc.is_nan(c)).as_py() for c in batch.columns):
                    raise ValueError("SQLite has no NaN")
                db.executemany(insert, zip(*[c.to_pylist() for c in batch.columns], strict=True))
                n += batch.num_rows
            db.execute("COMMIT")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ship(df.sparkSession)
    df.mapInArrow(put, "n bigint").agg(F.sum("n")).collect()
    with closing(sqlite3.connect(path, timeout=WAIT)) as db, db:
        db.execute(f"DROP TABLE {parts}")
        if index:
            db.execute(f"CREATE INDEX {_quoted(f'{table}_{index}')} ON {name} ({_quoted(index)})")


def read_sqlite(spark: SparkSession, path: str, table: str, even: tuple[str, int] | None = None) -> Dataset:
    """A table; with ``even`` (column, n) by about n tasks of about as many rows each, as of JDBC, else by one."""
    path, name = _local(path), _quoted(table)
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    with closing(sqlite3.connect(path, timeout=WAIT)) as db:
        declared = db.execute(f"PRAGMA table_info({name})").fetchall()
        if not declared:
            raise ValueError(f"no table {table} in {path}")
        for _, column, kind, *_ in declared:
            if kind.upper() not in _TYPES:
                raise TypeError(f"unsupported type of column {column}: {kind}")
        parts = even_predicates(lambda q: db.execute(q).fetchone(), name, _quoted(even[0]), even[1], "LIMIT 1 OFFSET {}") if even else ["TRUE"]
    schema = T.StructType([T.StructField(column, _TYPES[kind.upper()]()) for _, column, kind, *_ in declared])
    arrow = to_arrow_schema(schema)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(sqlite3.connect(path, timeout=WAIT)) as db:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    rows = db.execute(f"SELECT {', '.join(_quoted(f.name) for f in schema)} FROM {name} WHERE {part}")
                    while some := rows.fetchmany(ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    asked = ship(spark).createDataFrame(spark.sparkContext.parallelize([(p,) for p in parts], len(parts)), "part string")
    df = asked.mapInArrow(get, schema)
    return Dataset(df, schema_of(df))
