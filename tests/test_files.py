import datetime as dt
import json
from decimal import Decimal

import pyarrow as pa
import pyarrow.ipc as ipc
import pyarrow.parquet as pq
import pytest

from rowdelta import cli, generate, sinks, sources
from rowdelta.inspect import inspect_parquet
from rowdelta.model import DiffOptions
from rowdelta.plans import diff
from rowdelta.streaming import diff_stream


def test_type_detection():
    assert [sources.detect_type(p) for p in ("a.parquet", "a.ARROW", "b.csv/", "c.duckdb", "d")] == ["parquet", "arrow", "csv", "duckdb", "parquet"]
    for bad in ("d", "c.db"):
        with pytest.raises(ValueError, match="cannot tell"):
            sources.detect_type(bad, strict=True)


def test_registries(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported reader type: duckdb"):
        sources.read(spark, "x.db")
    with pytest.raises(ValueError, match="path"):
        sources.read(spark, "")
    with pytest.raises(ValueError, match="unsupported writer type: xml"):
        sinks.write(spark.range(1), "x", "xml")
    sources.register("numbers", lambda spark, path: sources.read_parquet(spark, path))
    spark.range(3).write.parquet(str(tmp_path / "n"))
    assert sources.read(spark, str(tmp_path / "n"), "numbers").df.count() == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name,score\n1,"a,b",1.5\n2,,\n3,x,2\n')
    data = sources.read(spark, str(path))
    assert data.df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    assert [tuple(r) for r in data.df.collect()] == [(1, "a,b", 1.5), (2, None, None), (3, "x", 2.0)]
    assert [str(f.type) for f in data.schema.fields] == ["int64", "string", "double"]


def test_arrow_batches_and_types(spark, tmp_path):
    path = str(tmp_path / "a.arrow")
    schema = pa.schema([("u", pa.uint32()), ("d", pa.dictionary(pa.int8(), pa.string())), ("t", pa.timestamp("ms")), ("l", pa.large_string())], {"primary_key": "u"})
    with ipc.new_file(path, schema) as w:
        for i in range(3):
            w.write_batch(pa.record_batch([pa.array([i, None], pa.uint32()), pa.array(["x", None]).dictionary_encode().cast(schema.field(1).type), pa.array([i, None], pa.timestamp("ms")), pa.array(["é", None], pa.large_string())], schema=schema))
    data = sources.read(spark, path)
    assert data.df.rdd.getNumPartitions() == 3 and data.df.count() == 6
    assert data.schema.metadata == {"primary_key": "u"} and str(data.schema.fields[1].type).startswith("dictionary")
    assert data.df.dtypes == [("u", "bigint"), ("d", "string"), ("t", "timestamp_ntz"), ("l", "string")]
    with ipc.new_file(str(tmp_path / "e.arrow"), schema):
        pass
    assert sources.read(spark, str(tmp_path / "e.arrow")).df.count() == 0
    with pytest.raises(FileNotFoundError):
        sources.read(spark, str(tmp_path / "no.arrow"))


def test_parquet_facts_and_unreadable_types(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"a": pa.array([1], pa.uint16())}, schema=pa.schema([pa.field("a", pa.uint16(), False)], {"k": "v"})), path)
    data = sources.read(spark, path)
    assert (str(data.schema.fields[0].type), data.schema.fields[0].nullable, data.schema.metadata) == ("uint16", False, {"k": "v"})
    pq.write_table(pa.table({"t": pa.array([1], pa.time64("us"))}), path)
    with pytest.raises(TypeError, match="unsupported type of column t"):
        sources.read(spark, path)


def test_last_row_of_a_file_wins(spark, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    pq.write_table(pa.table({"k": [1, 1, 2], "v": ["z", "a", "q"]}), a)
    pq.write_table(pa.table({"k": [1, 2, 2], "v": ["a", "q", "p"]}), b)
    x, y = (sources.read(spark, p, positions=True) for p in (a, b))
    found = diff(x, y, DiffOptions(("k",), ignore=x.position))
    assert [r["k"] for r in found.modified.collect()] == [2]


ROW = "SELECT 1 AS i, CAST(NULL AS STRING) AS s, DATE'2024-01-02' AS d, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, CAST(1.50 AS DECIMAL(9, 2)) AS m, array(1, NULL) AS a"


def test_sinks(spark, tmp_path, capsys):
    df = spark.sql(ROW + " UNION ALL " + ROW)
    for kind in ("parquet", "arrow"):
        path = str(tmp_path / f"o.{kind}")
        sinks.write(df, path, kind)
        assert sources.read(spark, path).df.exceptAll(df).count() == 0
    assert pq.ParquetFile(next((tmp_path / "o.parquet").glob("*.parquet"))).metadata.row_group(0).column(0).compression == "SNAPPY"
    sinks.write(df, str(tmp_path / "f.arrow"), "arrow_file")
    assert (tmp_path / "f.arrow").is_file() and sources.read(spark, str(tmp_path / "f.arrow")).df.exceptAll(df).count() == 0
    sinks.write(df, str(tmp_path / "o.json"), "json_array")
    rows = json.loads((tmp_path / "o.json").read_text())
    assert len(rows) == 2 and rows[0]["s"] is None and rows[0]["d"] == "2024-01-02" and rows[0]["m"] == 1.5 and rows[0]["a"] == [1, None]
    sinks.write(df.limit(0), str(tmp_path / "e.json"), "json_array")
    assert json.loads((tmp_path / "e.json").read_text()) == []
    sinks.write(df, str(tmp_path / "l"), "json")
    assert spark.read.json(str(tmp_path / "l")).count() == 2


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pair")
    a, b = str(d / "a.parquet"), str(d / "b.parquet")
    generate.write_pair(spark, a, b, generate.PairConfig(rows=2000, changed=0.2, nulls=0.1))
    return a, b


def test_generator(spark, pair):
    a, b = (spark.read.parquet(p) for p in pair)
    assert a.count() == b.count() == 2000 and a.select("id").distinct().count() == 2000
    assert set(b.columns) - set(a.columns) == {"state", "lat", "long", "last_login"}
    assert dict(a.dtypes)["score"] == "decimal(10,2)" and dict(a.dtypes)["created_at"] == "timestamp_ntz"
    s = diff(a, b, DiffOptions(("id",), unique_keys=True)).summary()
    assert s.added == s.deleted and 130 < s.added < 270 and 250 < s.modified < 550
    mails = b.where("email LIKE 'modified_%'")
    assert 250 < mails.count() < 500 and mails.where("email = concat('modified_', id, '@example.com')").count() == mails.count()
    assert a.where("email LIKE 'modified_%'").count() == 0 and sources.read(spark, pair[0]).schema.metadata["created_by"] == "rowdelta"
    again = generate.source(spark, generate.PairConfig(rows=2000, changed=0.2, nulls=0.1))
    assert a.exceptAll(again).count() == 0
    less = generate.target(spark, generate.PairConfig(rows=10, missing_columns=True, new_columns=False))
    assert set(a.columns) - set(less.columns) == {"created_at", "updated_at"}
    assert 0.05 < a.where("email IS NULL").count() / 2000 < 0.15
    errors = generate.PairConfig(rows=2000, changed=0.0, nulls=0.0, errors=0.2)
    e = diff(generate.source(spark, errors), generate.target(spark, errors), DiffOptions(("id",))).summary()
    assert set(e.columns) <= {"first_name", "age", "score", "balance"} and 200 < e.modified < 500


def test_inspect(spark, pair):
    text = inspect_parquet(spark, pair[0])
    assert "Number of rows: 2000" in text and "Field 0: id (string)" in text and text.count("Row ") == 5


def test_cli(spark, pair, tmp_path, capsys):
    run = lambda *a: (cli.main(list(a)), *capsys.readouterr())
    code, out, _ = run("diff", *pair, "--key", "id", "--output", str(tmp_path / "d"))
    assert code == 0 and "Source records: 2000" in out and "Modified columns:" in out
    saved = spark.read.parquet(str(tmp_path / "d"))
    assert {r[0] for r in saved.select("_change_type").distinct().collect()} == {"added", "deleted", "modified"}
    assert "_row_index" not in saved.columns
    code, out, err = run("diff", *pair, "--key", "id", "-f", "json", "--exit-code", "--unique-keys")
    assert code == 2 and len(json.loads(out)) == saved.count() and "Diff Summary" in err
    assert run("diff", pair[0], pair[0], "--full-load")[0] == 0
    for bad, message in ((("--full-load", "--stream"), "exclude"), (("--differ", "odd"), "unsupported differ"), (("--key", "nope"), "not found")):
        code, _, err = run("diff", *pair, *bad)
        assert code == 1 and message in err
    code, out, _ = run("schema", pair[0], "--required", "id,zip", "--non-nullable", "id", "--require-dict-encoding", "--require-utc", "--timestamp-fields", "created_at")
    assert code == 0 and "required fields missing: zip" in out and "Schema:" in out
    code, out, _ = run("schema", *pair, "--level", "relaxed", "-f", "json", "--exit-code")
    assert code == 0 and json.loads(out)["valid"] and len(json.loads(out)["differences"]) == 4
    code, out, _ = run("schema", *pair, "--level", "strict", "--exit-code")
    assert code == 2 and "Schema Comparison:" in out
    assert run("schema", "x.unknown")[0] == 1
    assert "rowdelta version" in run("version")[1]
    assert "Number of rows" in run("inspect", pair[0])[1] and "2000 values" in run("inspect", pair[0], "--statistics")[1]
    fast = run("diff", *pair, "--key", "id", "--unique-keys", "--checksums")
    assert fast[0] == 0 and fast[1] == run("diff", *pair, "--key", "id", "--unique-keys")[1]
    assert run("generate", str(tmp_path / "x.parquet"), str(tmp_path / "y.parquet"), "--rows", "10", "--no-new-columns")[0] == 0
    assert spark.read.parquet(str(tmp_path / "y.parquet")).count() == 10


def test_stream(spark, tmp_path):
    schema = "k int, v string"
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema)
    spark.createDataFrame([(1, "a"), (2, "x"), (9, "n")], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = diff_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, DiffOptions(("k",)), lambda r, n: seen.append(r.summary()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(s.added, s.deleted, s.modified) for s in seen] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        diff_stream(None, base, DiffOptions(), print, "x")


def test_values_survive_a_diff(spark):
    row = (1, Decimal("1.10"), dt.date(2024, 1, 2), bytearray(b"\x00\xff"), [1.0, None])
    schema = "id int, m decimal(9,2), d date, b binary, a array<double>"
    found = diff(spark.createDataFrame([row], schema), spark.createDataFrame([], schema), DiffOptions(("id",))).deleted
    assert tuple(found.first()) == row


def test_metadata_reaches_files(spark, tmp_path):
    found = diff(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "x")], "id int, v string"), DiffOptions(("id",)))
    sinks.write(found.modified, str(tmp_path / "m.parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "m.parquet")).schema["_modified_v"].metadata == found.metadata
    for kind in ("arrow", "arrow_file"):
        sinks.write_diff(found, str(tmp_path / f"{kind}.arrow"), kind)
        info = sources.read(spark, str(tmp_path / f"{kind}.arrow")).schema
        assert info.metadata["modified_record"] == "true" and info.metadata == found.metadata


def test_jdbc_ranges(spark):
    with pytest.raises(ValueError, match="ranges"):
        sources.read(spark, "jdbc:none", "jdbc", query="SELECT 1", ranges=("id", 0, 9, 3))
