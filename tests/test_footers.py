import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowdelta import sinks, sources
from rowdelta.inspect import column_statistics, inspect_parquet
from rowdelta.sources.footers import columns_of, disagreements, footers, merged_schema, row_groups
from rowdelta.sources.hadoop import HadoopFile, data_files


@pytest.fixture
def far(spark, tmp_path):
    """The folder by a scheme that only Hadoop opens."""
    name = f"far{uuid.uuid4().hex}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return f"viewfs://{name}/in"


@pytest.fixture
def parts(tmp_path):
    """Three files: one lacks a column, one declares one without nulls, two contradict each other in metadata."""
    (tmp_path / "t").mkdir()
    plain = {"a": pa.int64(), "b": pa.string()}
    for name, fields, meta in (
        ("x", [pa.field("a", pa.int64()), pa.field("b", pa.string(), False)], {"owner": "one", "version": "1"}),
        ("y", [pa.field("a", pa.int64())], {"owner": "one", "version": "2"}),
        ("z", [pa.field("a", pa.int64()), pa.field("b", pa.string(), False)], {"owner": "one"}),
    ):
        data = {f.name: pa.array([1, 2, None] if f.type == plain["a"] else ["p", "q", "r"], f.type) for f in fields}
        pq.write_table(pa.table(data, schema=pa.schema(fields, meta)), str(tmp_path / "t" / f"{name}.parquet"), row_group_size=2)
    (tmp_path / "t" / "_SUCCESS").touch()
    (tmp_path / "t" / ".hidden").mkdir()
    (tmp_path / "t" / ".hidden" / "h.parquet").write_text("no file of the table")
    return "t"


@pytest.mark.parametrize("where", ["near", "far"])
def test_footers_and_row_groups(spark, tmp_path, far, parts, where):
    path = f"{far if where == 'far' else tmp_path}/{parts}"
    found = {r["file"][-9:]: r for r in footers(spark, path).collect()}
    assert {k: (r["rows"], r["row_groups"], r["columns"]) for k, r in found.items()} == {"x.parquet": (3, 2, 2), "y.parquet": (3, 2, 1), "z.parquet": (3, 2, 2)}
    assert found["x.parquet"]["metadata"]["version"] == "1" and found["x.parquet"]["created_by"].startswith("parquet-cpp")
    groups = {(r["file"][-9:], r["row_group"], r["column"]): r for r in row_groups(spark, path).collect()}
    assert len(groups) == 10
    r = groups["y.parquet", 1, "a"]
    assert (r["group_rows"], r["n_values"], r["nulls"], r["least"], r["type"]) == (1, 1, 1, None, "INT64")
    r = groups["z.parquet", 0, "b"]
    assert (r["nulls"], r["least"], r["greatest"], r["compression"]) == (0, "p", "q", "SNAPPY")


def test_what_files_declare_is_merged(spark, tmp_path, parts):
    found = footers(spark, str(tmp_path / parts))
    info = merged_schema(found)
    assert [(f.name, str(f.type), f.nullable) for f in info.fields] == [("a", "int64", True), ("b", "string", True)]
    assert info.metadata == {"owner": "one"}
    rows = {(r["column"], r["fact"], r["value"], r["n_files"], r["example"][-9:]) for r in disagreements(found).collect()}
    assert rows == {("b", "missing", None, 1, "y.parquet")}
    data = sources.read(spark, str(tmp_path / parts))
    assert data.schema == info and data.df.columns == ["a", "b"] and data.df.where("b is null").count() == 3
    assert {tuple(r)[1:] for r in columns_of(found).where("file like '%x.parquet'").collect()} == {(0, "a", "int64", True), (1, "b", "string", False)}


def test_columns_of_two_types_are_an_error(spark, tmp_path):
    for name, kind in (("a", pa.int64()), ("b", pa.string())):
        pq.write_table(pa.table({"v": pa.array([None], kind)}), str(tmp_path / f"{name}.parquet"))
    with pytest.raises(TypeError, match="column v is int64 in .*a.parquet and string in .*b.parquet"):
        sources.read(spark, str(tmp_path))
    facts = {(r["fact"], r["value"], r["n_files"]) for r in disagreements(footers(spark, str(tmp_path))).collect()}
    assert facts == {("type", "int64", 1), ("type", "string", 1)}


def test_no_files(spark, tmp_path):
    assert data_files(spark, str(tmp_path / "none")) == [] and footers(spark, str(tmp_path)).count() == 0
    assert row_groups(spark, str(tmp_path)).collect() == [] and disagreements(footers(spark, str(tmp_path))).collect() == []


def test_rules_see_one_schema_wherever_the_file_is(spark, tmp_path, far):
    pq.write_table(pa.table({"a": [1]}, schema=pa.schema([pa.field("a", pa.int64(), False)], {"k": "v"})), str(tmp_path / "one.parquet"))
    near, away = sources.read(spark, str(tmp_path / "one.parquet")), sources.read(spark, f"{far}/one.parquet")
    assert near.schema == away.schema and not near.schema.fields[0].nullable and near.schema.metadata == {"k": "v"}
    with HadoopFile(spark, f"{far}/one.parquet") as f:
        whole = f.read()
        assert whole[-4:] == b"PAR1" and f.read() == b"" and f.seek(-4, 2) == f.size - 4 and f.read(2) == b"PA"


def test_inspector_adds_up_row_groups(spark, tmp_path, parts):
    path = str(tmp_path / parts)
    stats = {r["column"]: r for r in column_statistics(spark, path).collect()}
    assert {k: (r["row_groups"], r["n_values"], r["nulls"]) for k, r in stats.items()} == {"a": (6, 9, 3), "b": (4, 6, 0)}
    text = inspect_parquet(spark, path, statistics=True)
    assert "Number of files: 3\nNumber of rows: 9\nNumber of row groups: 6" in text and "owner: one" in text
    assert "a (INT64): 9 values, 3 nulls" in text


@pytest.mark.parametrize("where", ["near", "far"])
@pytest.mark.parametrize("kind", ["parquet", "arrow"])
def test_files_are_replaced_and_read_back(spark, tmp_path, far, kind, where):
    path = f"{far if where == 'far' else tmp_path}/out.{kind}"
    df = spark.sql("SELECT id, if(id % 3 = 0, null, concat('é', id)) AS s, cast(id AS decimal(12,2)) AS m, timestamp_ntz'2024-01-02 03:04:05' AS t, array(id, null) AS a FROM range(0, 1000, 1, 3)")
    for n in (1000, 400):
        sinks.write_files(df.where(F.col("id") < n), path, kind, {"made": "here"})
        back = sources.read(spark, path, kind)
        assert back.df.count() == n and back.schema.metadata["made"] == "here"
        assert back.df.exceptAll(df).count() == 0
    names = [f for f, _ in data_files(spark, path)]
    assert names and all(f.endswith(f".{kind}") for f in names)
    sinks.write_files(df.where("false"), path, kind)
    assert sources.read(spark, path, kind).df.columns == df.columns and sources.read(spark, path, kind).df.count() == 0


def test_files_are_closed_by_size_and_divided_by_value(spark, tmp_path):
    df = spark.sql("SELECT id, if(id % 10 = 0, null, cast(id % 2 AS string)) AS kind FROM range(0, 30000, 1, 2)")
    path = str(tmp_path / "o.parquet")
    sinks.write_files(df, path, "parquet", partition="kind", file_bytes=20_000)
    assert len(data_files(spark, path)) > 6
    back = spark.read.parquet(path)
    assert {r[0]: r[1] for r in back.groupBy("kind").count().collect()} == {None: 3000, 0: 12000, 1: 15000}
    assert {tuple(r) for r in back.selectExpr("id", "cast(kind AS string)").collect()} == {tuple(r) for r in df.collect()}


def test_writing_arrow_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "o.arrow")
    for _ in range(2):
        sinks.write(spark.range(10), path, "arrow")
    assert sources.read(spark, path).df.count() == 10


def test_combined_output_has_metadata_in_every_footer(spark, tmp_path):
    from rowdelta.model import DiffOptions
    from rowdelta.plans import diff

    a, b = spark.sql("SELECT id, id AS v FROM range(20)"), spark.sql("SELECT id + 5 AS id, id AS v FROM range(20)")
    found = diff(a, b, DiffOptions(("id",)))
    path = str(tmp_path / "o.parquet")
    sinks.write_diff(found, path)
    own = footers(spark, path).collect()
    assert own and all(r["metadata"]["modified_record"] == "true" and r["metadata"]["modification_time"] == found.metadata["modification_time"] for r in own)
    back = spark.read.parquet(path)
    assert {r[0]: r[1] for r in back.groupBy("_change_type").count().collect()} == {"added": 5, "deleted": 5, "modified": 15}
    assert sources.read(spark, path).schema.metadata["modified_record"] == "true"
    sinks.write_diff(diff(a, a, DiffOptions(("id",))), path)
    assert spark.read.parquet(path).count() == 0 and "_change_type" in spark.read.parquet(path).columns
