"""The shape, statistics and first rows of Parquet files as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.sources.files import read_parquet
from rowdelta.sources.footers import footers, row_groups


def column_statistics(spark: SparkSession, path: str) -> DataFrame:
    """A row for each leaf column: row groups, values, nulls and bytes over all files, from footers alone.

    nulls is null where a row group does not say."""
    known = F.when(F.count_if(F.col("nulls").isNull()) == 0, F.sum("nulls")).alias("nulls")
    return row_groups(spark, path).groupBy("column", "type").agg(F.count(F.lit(1)).alias("row_groups"), F.sum("n_values").alias("n_values"), known, F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"))


def inspect_parquet(spark: SparkSession, path: str, rows: int = 5, statistics: bool = False) -> str:
    data = read_parquet(spark, path)
    found = footers(spark, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("row_groups"), F.lit(0)).alias("groups")).first()
    lines = [f"File: {path}"]
    if found["files"] > 1:
        lines.append(f"Number of files: {found['files']}")
    lines += [f"Number of rows: {found['rows'] if found['files'] else data.df.count()}", f"Number of row groups: {found['groups']}"]
    lines += ["", "Schema:", *(f"  Field {i}: {f.name} ({f.type})" for i, f in enumerate(data.schema.fields))]
    if data.schema.metadata:
        lines += ["", "Metadata:", *(f"  {k}: {v}" for k, v in sorted(data.schema.metadata.items()))]
    if statistics:
        lines += ["", "Columns:"]
        for r in column_statistics(spark, path).orderBy("column").toLocalIterator():
            lines.append(f"  {r['column']} ({r['type']}): {r['n_values']} values, {'unknown' if r['nulls'] is None else r['nulls']} nulls, {r['compressed']} of {r['uncompressed']} bytes in {r['row_groups']} row groups")
    lines += ["", f"First {rows} rows:"]
    for i, row in enumerate(data.df.limit(rows).collect()):
        lines += [f"Row {i}:", *(f"  {n}: {'NULL' if v is None else v}" for n, v in zip(data.df.columns, row, strict=True))]
    return "\n".join(lines) + "\n"
