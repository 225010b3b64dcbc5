import datetime as dt
import os
import re
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from rowdelta import sources
from rowdelta.queries import DERBY
from rowdelta.sources.files import quantile_predicates


@pytest.fixture(scope="module")
def base(spark):
    """A table with a run of close values, one value that a third of the rows share, and rows without one."""
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    v = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 7).when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 1_000_000)
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 50).cast("int"))
    df = spark.range(1000).select("id", v.alias("v"), F.concat(F.lit("o'"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("s"), day.alias("d"), F.timestamp_seconds(F.col("id") * 100).alias("t"), (F.col("id") / 3).alias("w"))
    df.write.format("jdbc").option("url", url).option("dbtable", "t").option("createTableColumnTypes", "s VARCHAR(20)").option("driver", DERBY).save()
    return url, df


@pytest.mark.parametrize("column, parts, most", [("v", 5, 400), ("s", 8, 130), ("d", 8, 150), ("t", 8, 130), ("w", 8, 130), ("id", 1, 1000)])
def test_parts_are_even_and_whole(spark, base, column, parts, most):
    url, df = base
    read = sources.read(spark, url, "jdbc", table="t", even=(column, 8), driver=DERBY).df
    assert read.rdd.getNumPartitions() <= 9
    sizes = [r[0] for r in read.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= (most if column != "id" else 130) and len(sizes) >= parts
    assert read.toDF(*df.columns).exceptAll(df).count() == 0


def test_equal_ranges_would_not_be_even(spark, base):
    read = sources.read(spark, base[0], "jdbc", table="t", ranges=("v", 0, 999_000_000, 8), driver=DERBY).df
    assert max(r[0] for r in read.groupBy(F.spark_partition_id()).count().select("count").collect()) > 800
    assert read.count() == 1000


def test_small_and_odd_tables(spark, base):
    url, _ = base
    assert quantile_predicates(spark, url, '(SELECT * FROM t WHERE "id" < 0) e', "v", 4, driver=DERBY) == ['"v" IS NOT NULL']
    assert quantile_predicates(spark, url, '(SELECT * FROM t WHERE "id" = 0) e', "v", 4, driver=DERBY) == ['"v" IS NOT NULL', '"v" IS NULL']
    one = quantile_predicates(spark, url, '(SELECT * FROM t WHERE "v" = 7) e', "v", 4, driver=DERBY)
    assert one == ['"v" < 7', '"v" >= 7']
    assert sources.read(spark, url, "jdbc", query="SELECT COUNT(*) AS n FROM t", driver=DERBY).df.first()[0] == 1000
    with pytest.raises(ValueError, match="even parts"):
        sources.read(spark, url, "jdbc", query="SELECT 1", even=("v", 2))
    with pytest.raises(ValueError, match="ranges are of a table"):
        sources.read(spark, url, "jdbc", query="SELECT 1", ranges=("v", 0, 1, 2))


@pytest.mark.parametrize("column, most", [("v", 400), ("s", 130), ("w", 130)])
def test_a_file_that_several_processes_open(spark, base, tmp_path, column, most):
    df = base[1].drop("d", "t").repartition(5)
    path = str(tmp_path / "t.sqlite")
    sources.write_sqlite(df, path, "t", index=column)
    read = sources.read(spark, f"file://{path}", "sqlite", table="t", even=(column, 8)).df
    sizes = [r[0] for r in read.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= most and len(sizes) >= 5
    assert read.dtypes == df.dtypes
    assert read.exceptAll(df).count() == 0 and df.exceptAll(read).count() == 0
    with pytest.raises(FileExistsError):
        sources.write_sqlite(df, path, "t")


def test_a_file_refuses_what_it_cannot_hold(spark, tmp_path):
    with pytest.raises(TypeError, match="unsupported type of column d"):
        sources.write_sqlite(spark.sql("SELECT current_date() AS d"), str(tmp_path / "a.sqlite"), "t")
    with pytest.raises(Exception, match="SQLite has no NaN"):
        sources.write_sqlite(spark.sql("SELECT double('NaN') AS x"), str(tmp_path / "b.sqlite"), "t")


def test_query_where_executors_are_other_processes(tmp_path):
    """In a process of its own, since a session's master is fixed."""
    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
from rowdelta.queries import QUERIES
conf = {{"spark.ui.enabled": "false", "spark.executor.memory": "512m", "spark.checkpoint.dir": {str(tmp_path)!r}}}
spark = SparkSession.builder.master("local-cluster[2,1,700]").config(map=conf).getOrCreate()
rows = QUERIES["source_database_even_parts"](spark, "/root/testdata/sf0.001").collect()
print("ROWS", len(rows), sum(r["o_orderpriority"] is None for r in rows))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert re.search(r"^ROWS 1500 \d+$", done.stdout, re.M), done.stderr[-2000:]
