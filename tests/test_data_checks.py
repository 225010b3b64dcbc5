import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest

from rowdelta.schema import DecimalPrecisionRule, DictionaryEncodingRule, FieldTypeRule, MetadataRule, NullabilityRule, RequiredFieldsRule, TemporalFormatRule, parse_type
from rowdelta.schema.data_checks import check_data


def broken(spark, rule, kind, values, keys=("k",)):
    df = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    rows = check_data(df, [rule], keys).collect()
    assert [(r["field"], r["rows"]) for r in rows] == [("v", len(values))]
    return rows[0]["violations"], rows[0]["first_key"]


@pytest.mark.parametrize(
    "have, want, values, n, first",
    [
        ("string", "int32", ["1", " -7 ", None, "1.5", "x", "3000000000", ""], 4, 3),
        ("string", "double", ["1", "1e5", "NaN", "one", None], 1, 3),
        ("string", "decimal(6,2)", ["1.25", "1.2500", "1.255", "12345.6", None], 2, 2),
        ("string", "date32", ["2024-02-29", "2023-02-29", None], 1, 1),
        ("string", "bool", ["true", "no", "maybe"], 1, 2),
        ("bigint", "int32", [1, -(1 << 31), 1 << 31, None], 1, 2),
        ("double", "int64", [1.0, -0.0, 1.5, 1e30, None], 2, 2),
        ("double", "float", [0.5, 0.1, None], 1, 1),
        ("int", "int64", [1, None], 0, None),
        ("int", "int32", [1, None], 0, None),
        ("int", "string", [1, None], 0, None),
        ("timestamp_ntz", "date32", [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 1), None], 1, 1),
        ("array<int>", "int32", [[1], None], 1, 0),
        ("date", "int32", [dt.date(2024, 1, 1), None], 1, 0),
    ],
)
def test_values_that_another_type_would_lose(spark, have, want, values, n, first):
    got = broken(spark, FieldTypeRule({"v": [pa.date32() if want == "date32" else parse_type(want)]}), have, values)
    assert got == (n, None if first is None else f'{{"k":{first}}}')


def test_one_of_several_types_is_enough(spark):
    rule = FieldTypeRule({"v": [pa.int32(), pa.date32()]})
    assert broken(spark, rule, "string", ["5", "2024-01-01", "5.5", None])[0] == 1


def test_nulls_blanks_and_absent_fields(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", 1.0), (3, None, None)], "k int, s string, w double")
    rules = [RequiredFieldsRule(["s", "w", "gone"]), NullabilityRule(["s", "gone"]), MetadataRule(["owner"]), DictionaryEncodingRule()]
    got = {(r["rule"], r["field"]): (r["violations"], r["first_key"]) for r in check_data(df, rules, ["w", "k"]).collect()}
    assert got == {("RequiredFieldsRule", "s"): (2, '{"w":null,"k":3}'), ("RequiredFieldsRule", "w"): (2, '{"w":null,"k":1}'), ("NullabilityRule", "s"): (1, '{"w":null,"k":3}')}
    assert check_data(df, [MetadataRule(["owner"])]).collect() == []
    assert [r["first_key"] for r in check_data(df, [NullabilityRule(["s"])]).collect()] == [None]
    assert [(r["rows"], r["violations"]) for r in check_data(df.limit(0), rules).collect()] == [(0, 0)] * 3


def test_decimals_and_times(spark):
    assert broken(spark, DecimalPrecisionRule({"v": (5, 2)}), "double", [1.25, 1.255, 999.99, 1000.0, float("nan"), None])[0] == 3
    assert broken(spark, DecimalPrecisionRule({"v": (5, 2)}), "decimal(9,3)", [Decimal("1.250"), Decimal("1.255"), Decimal("1000"), None])[0] == 2
    utc = TemporalFormatRule(["v"], timezone="UTC")
    assert broken(spark, utc, "string", ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00+00:00", "2024-01-01 00:00:00+02:00", "2024-01-01 00:00:00", "soon", None]) == (3, '{"k":2}')
    assert broken(spark, TemporalFormatRule(["v"]), "string", ["2024-01-01 00:00:00", "soon"])[0] == 1
    assert broken(spark, TemporalFormatRule(dates=["v"]), "date", [dt.date(2024, 1, 1)])[0] == 0


def test_one_pass_reads_asked_columns_only(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.sql("SELECT id AS k, id AS a, id AS b, id AS c FROM range(10)").write.parquet(path)
    plan = check_data(spark.read.parquet(path), [NullabilityRule(["a"]), RequiredFieldsRule(["b"])], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "c:bigint" not in plan and plan.count("Exchange") == 1
