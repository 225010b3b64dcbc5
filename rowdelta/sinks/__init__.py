"""Writers by type name, the combined output of a diff and its text summary."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.model import DiffResult, DiffSummary
from rowdelta.workers import ship

from .files import arrow_schema_of, write_files


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy, no dictionary encoding."""
    df.write.mode(mode).option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One indented array of row objects in one file, for small results: rows pass through the driver, a partition at
    a time."""
    with open(path, "w", encoding="utf-8") as f:
        json_array(df, f)


def json_array(df: DataFrame, out: TextIO) -> None:
    """Nulls, times, decimals and nested values keep their meaning."""
    first = True
    out.write("[")
    for row in df.select(F.to_json(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]), {"ignoreNullFields": "false"})).toLocalIterator(prefetchPartitions=True):
        text = json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False)
        out.write(("\n  " if first else ",\n  ") + text.replace("\n", "\n  "))
        first = False
    out.write("]\n" if first else "\n]\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    """The form that executors write in parallel."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_arrow_file(df: DataFrame, path: str) -> None:
    """One IPC file, for small results: executors make its batches, the driver fetches and writes them one by one."""
    schema = arrow_schema_of(df)
    ship(df.sparkSession)

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.cast(schema).serialize().to_pybytes()], pa.binary())], ["batch"])

    with pa.OSFile(path, "wb") as f, ipc.new_file(f, schema) as w:
        for row in df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            w.write_batch(ipc.read_record_batch(pa.py_buffer(bytes(row[0])), schema))


def write_arrow_folder(df: DataFrame, path: str) -> None:
    """IPC files that executors write in parallel, on any file system; what was at ``path`` is replaced."""
    write_files(df, path, "arrow")


Writer = Callable[[DataFrame, str], None]
#: What executors write in parallel, and forms of one file that the driver writes.
WRITERS: dict[str, Writer] = {"parquet": write_parquet, "arrow": write_arrow_folder, "json": write_json_lines, "arrow_file": write_arrow_file, "json_array": write_json_array}


def register(kind: str, writer: Writer) -> None:
    WRITERS[kind] = writer


def write(df: DataFrame, path: str, kind: str) -> None:
    if not path:
        raise ValueError("a path is required")
    if kind not in WRITERS:
        raise ValueError(f"unsupported writer type: {kind}")
    WRITERS[kind](df, path)


def write_diff(result: DiffResult, path: str, kind: str = "parquet") -> None:
    """Added, deleted and modified rows in one output with ``_change_type``.

    Parquet files, in a folder for each kind, have the result's metadata in their footers. Snappy, no dictionaries."""
    changes = result.changes()
    with result.running():
        if kind == "parquet":
            write_files(changes, path, "parquet", result.metadata, "_change_type")
        else:
            write(changes, path, kind)


def summary_text(summary: DiffSummary) -> str:
    lines = [
        "",
        "Diff Summary:",
        f"  Source records: {summary.total_source}",
        f"  Target records: {summary.total_target}",
        f"  Added records:   {summary.added}",
        f"  Deleted records: {summary.deleted}",
        f"  Modified records: {summary.modified}",
    ]
    if summary.columns:
        lines += ["", "Modified columns:", *(f"  {c}: {n} modifications" for c, n in summary.columns.items())]
    return "\n".join(lines) + "\n"


def print_summary(summary: DiffSummary, out: TextIO | None = None) -> None:
    (out or sys.stdout).write(summary_text(summary))
