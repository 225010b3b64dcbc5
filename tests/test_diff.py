import dataclasses
import datetime as dt
import itertools
import random
import warnings
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowdelta.model import Dataset, Differ, DiffOptions, SchemaInfo
from rowdelta.operators import Side, check_types, compare_columns, narrow, resolve_keys
from rowdelta.plans import SparkDiffer, diff
from rowdelta.plans.one_pass import hot_keys, key_hash
from rowdelta.schema import schema_of


@pytest.fixture
def people(spark):
    schema = "id long, name string, value double, active boolean"
    source = spark.createDataFrame([(1, "Alice", 10.5, True), (2, "Bob", 20.5, False), (9, "Gone", 1.0, None)], schema)
    target = spark.createDataFrame([(1, "Alice", 10.5, True), (2, "Bobby", 20.50001, None), (3, "Charlie", 30.0, False)], schema)
    return source, target


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("tolerance", [1e-4, 0.1])
def test_row_compare(people, unique, tolerance):
    found = diff(*people, DiffOptions(("id",), tolerance=tolerance, unique_keys=unique))
    assert rows(found.added) == [(3, "Charlie", 30.0, False)]
    assert rows(found.deleted) == [(9, "Gone", 1.0, None)]
    assert rows(found.modified) == [(2, "Bob", 20.5, False, False, True, False, True)]
    s = found.summary()
    assert (s.total_source, s.total_target, s.added, s.deleted, s.modified) == (3, 3, 1, 1, 1)
    assert s.columns == {"name": 1, "active": 1}
    assert rows(found.column_counts) == [("active", 1), ("name", 1)]


def test_modified_schema(people):
    found = diff(*people, DiffOptions(("id",)))
    assert found.modified.columns == ["id", "name", "value", "active", "_modified_id", "_modified_name", "_modified_value", "_modified_active"]
    flags = [f for f in found.modified.schema.fields if f.name.startswith("_modified_")]
    assert all(f.dataType.simpleString() == "boolean" and not f.nullable for f in flags)
    assert found.metadata["modified_record"] == "true" and "modification_time" in found.metadata


def test_types_are_checked_first(spark):
    source = spark.createDataFrame([], "id long not null, name string, value double").schema
    check_types(source, spark.createDataFrame([], "id long, name string, value double not null, extra long").schema)
    bad = spark.createDataFrame([], "id long, name string, value long").schema
    with pytest.raises(TypeError, match="incompatible types for column value"):
        check_types(source, bad)
    check_types(source, bad, ["value"])


def test_key_resolution():
    assert resolve_keys(["a", "b"], "p", ["a", "b", "p"]) == ["a", "b"]
    assert resolve_keys([], "p,q", ["a", "p,q"]) == ["p,q"]
    with pytest.warns(UserWarning, match="no key columns"):
        assert resolve_keys([], None, ["a", "b", "c"], ["b"]) == ["a", "c"]
    with pytest.raises(ValueError, match="no key columns"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        resolve_keys([], None, ["a"], ["a"])
    assert compare_columns(["a", "b", "c"], ["a"], ["c"]) == ["b"]


def test_missing_key(people):
    with pytest.raises(ValueError, match="key column not found: nope"):
        diff(*people, DiffOptions(("nope",)))


def test_primary_key_of_the_metadata(people):
    info = SchemaInfo(schema_of(people[0]).fields, {"primary_key": "id"})
    assert diff(Dataset(people[0], info), people[1]).summary().modified == 1


def test_last_of_several_rows_wins_and_duplicates_count(spark):
    schema = "k int, o int, v string"
    source = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (2, 1, "x")], schema)
    target = spark.createDataFrame([(1, 1, "z"), (1, 2, "b"), (3, 1, "n"), (3, 2, "m")], schema)
    found = diff(source, target, DiffOptions(("k",), order_by=("o",)))
    s = found.summary()
    assert (s.added, s.deleted, s.modified, s.total_source, s.total_target) == (2, 2, 0, 4, 4)
    assert rows(found.added) == [(3, 1, "n"), (3, 2, "m")] and rows(found.deleted) == [(2, 1, "x"), (2, 1, "x")]
    assert diff(source, target.withColumn("o", -F.col("o")), DiffOptions(("k",), order_by=("o",), ignore=("o",))).summary().columns == {"v": 1}


def test_null_keys(spark):
    source = spark.createDataFrame([(None, 1), ("NULL", 2), ("", 3)], "k string, v int")
    target = spark.createDataFrame([(None, 1), ("NULL", 5)], "k string, v int")
    s = diff(source, target, DiffOptions(("k",))).summary()
    assert (s.added, s.deleted, s.modified) == (0, 1, 1)
    # as text, a null key is the text NULL: the last of both rows is compared
    assert diff(source, target, DiffOptions(("k",), key_style="text", order_by=("v",))).summary().modified == 1


def test_text_keys_collide(spark):
    source = spark.createDataFrame([("a|b", "c")], "k1 string, k2 string")
    target = spark.createDataFrame([("a", "b|c")], "k1 string, k2 string")
    assert diff(source, target, DiffOptions(("k1", "k2"))).summary().added == 1
    assert diff(source, target, DiffOptions(("k1", "k2"), key_style="text")).summary().added == 0
    with pytest.raises(ValueError, match="unknown key style"):
        diff(source, target, DiffOptions(("k1",), key_style="x"))


def test_no_keys_never_modified(people):
    with pytest.warns(UserWarning):
        s = diff(*people, DiffOptions(tolerance=1.0)).summary()
    assert (s.added, s.deleted, s.modified) == (2, 2, 0)


def test_columns_on_one_side(spark):
    source = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, a string, b int")
    target = spark.createDataFrame([(1, "a", 5.0)], "id int, a string, c double")
    found = diff(source, target, DiffOptions(("id",)))
    assert rows(found.modified) == [(1, "a", 1, False, False, True)]
    assert diff(source, target, DiffOptions(("id",), ignore=("b",))).summary().modified == 0


def test_names_with_dots_and_case(spark):
    source = spark.createDataFrame([(1, "x", "p")], ["id", "a.b", "A.B"])
    target = spark.createDataFrame([(1, "x", "q")], ["id", "a.b", "A.B"])
    assert diff(source, target, DiffOptions(("id",))).summary().columns == {"A.B": 1}
    with pytest.raises(ValueError, match="named like flags"):
        diff(spark.createDataFrame([(1, 2)], "a int, _modified_a int"), spark.createDataFrame([(1, 2)], "a int, _modified_a int"), DiffOptions(("a",)))


def test_nested_and_decimal_values(spark):
    q = "SELECT 1 AS id, array(1, {0}) AS a, named_struct('x', {0}) AS s, map('k', {0}) AS m, CAST({0} AS DECIMAL(10, 2)) AS d"
    found = diff(spark.sql(q.format(1)), spark.sql(q.format(2)), DiffOptions(("id",), tolerance=10.0))
    assert found.summary().columns == {"a": 1, "s": 1, "m": 1, "d": 1}


def test_empty_sides(people, spark):
    empty = spark.createDataFrame([], people[0].schema)
    s = diff(empty, people[1], DiffOptions(("id",))).summary()
    assert (s.total_source, s.added, s.deleted, s.modified, s.columns) == (0, 3, 0, 0, {})
    found = diff(empty, empty, DiffOptions(("id",)))
    assert found.summary().total_target == 0
    assert found.added.schema == people[0].schema and found.modified.count() == 0


def test_changes_have_one_shape(people):
    found = diff(*people, DiffOptions(("id",))).changes()
    assert {r["_change_type"]: r["name"] for r in found.collect()} == {"added": "Charlie", "deleted": "Gone", "modified": "Bob"}


def test_target_values(people):
    r = diff(*people, DiffOptions(("id",), target_values=True)).modified.first()
    assert (r["name"], r["_target_name"]) == ("Bob", "Bobby")


def test_validation_before_a_diff(people):
    with pytest.raises(ValueError, match="schemas do not agree"):
        diff(people[0], people[1].drop("name"), DiffOptions(("id",), validate="strict"))


def test_differ(people, spark):
    differ = SparkDiffer()
    assert isinstance(differ, Differ)
    assert differ.diff(*people, DiffOptions(("id",))).summary().modified == 1
    differ.cancel(spark)
    differ.close()


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_each_side_is_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        schema = "k string, v int"
        a, b = (spark.createDataFrame([(None, 1), ("a", 2)], schema) for _ in range(2))
        for unique in (True, False):
            found = diff(a, b, DiffOptions(("k",), unique_keys=unique, order_by=("v",)))
            assert _exchanges(found.summary_frame) == 2 and _exchanges(found.modified) == 2
        assert _exchanges(diff(a, b, DiffOptions(("k",))).added) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.sql("SELECT id, id AS a, id AS b FROM range(10)").write.parquet(path)
    df = spark.read.parquet(path)
    plan = diff(df, df, DiffOptions(("id",), ignore=("b",), unique_keys=True)).summary_frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,a:bigint>" in plan and "b:bigint" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.sql("SELECT id, id AS a FROM range(10)").write.parquet(path)
    df = spark.read.parquet(path).where("a > 5")
    plan = diff(df, df, DiffOptions(("id",))).modified._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(a), GreaterThan(a,5)]") == 2


def test_primary_key_metadata_from_a_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from rowdelta import sources

    for name, v in (("a", [1, 2]), ("b", [1, 3])):
        schema = pa.schema([("k", pa.int64()), ("v", pa.int64())], {"primary_key": "k"})
        pq.write_table(pa.table({"k": [7, 8], "v": v}, schema=schema), str(tmp_path / f"{name}.parquet"))
    found = diff(*(sources.read(spark, str(tmp_path / f"{n}.parquet")) for n in "ab"))
    assert found.summary().columns == {"v": 1}


def test_a_differ_tags_its_own_jobs_only(spark):
    from rowdelta.plans.diff import SparkDiffer

    one, two = SparkDiffer(), SparkDiffer()
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    found = one.diff(a, a, DiffOptions(("id",)))
    assert one.tag != two.tag and spark.getTags() == set()
    with found.running():
        assert spark.getTags() == {one.tag}
    one.cancel(spark)
    assert spark.getTags() == set() and found.summary().modified == 0 and spark.getTags() == set()


def test_last_row_by_a_map(spark):
    """Rows of a key that differ in a map only: the greatest by its entries in key order is the last, however rows come."""
    rows = [(1, {"b": 2, "a": 1}), (1, {"a": 1, "b": 3}), (1, {"a": 0, "b": 9})]
    for x in (rows, rows[::-1]):
        out = diff(spark.createDataFrame(x, "id int, m map<string,int>"), spark.createDataFrame([(1, {"b": 3, "a": 1})], "id int, m map<string,int>"), DiffOptions(("id",)))
        assert out.modified.count() == 0


@pytest.mark.parametrize("target_values", [True, False])
def test_one_join_gives_all_changes_of_unique_keys(spark, people, target_values):
    source, target = people
    target = target.withColumn("more", F.lit(5)).select("more", *reversed(target.columns))
    found = diff(source, target, DiffOptions(("id",), unique_keys=True, target_values=target_values))
    each = diff(source, target, DiffOptions(("id",), target_values=target_values))
    each.one_pass = None
    assert _exchanges(found.changes()) == 2
    assert found.changes().columns == each.changes().columns
    assert [f.dataType for f in found.changes().schema.fields] == [f.dataType for f in each.changes().schema.fields]
    assert rows(found.changes()) == rows(each.changes())
    assert found.changes().schema["_change_type"].metadata == found.metadata


def test_changes_of_names_that_differ_in_case(spark):
    source, target = spark.createDataFrame([(1, 2)], "id long, a long"), spark.createDataFrame([(2, 3)], "id long, A long")
    found = diff(source, target, DiffOptions(("id",), ignore=("a", "A"), unique_keys=True))
    assert found.one_pass is None and found.changes().count() == 2


def _random_pair(spark, seed, n=400, keys=40):
    rng = random.Random(seed)
    side = lambda: [(rng.choice([None, *range(keys)]), rng.choice([None, "a", "b"]), rng.choice([0.0, 1.0, 1.00001, float("nan"), None]), rng.randrange(3)) for _ in range(n)]
    return [spark.createDataFrame(side(), "k int, v string, w double, o int").repartition(3) for _ in range(2)]


@pytest.mark.parametrize("hot_rows", [100_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_gives_the_changes_of_three_joins(spark, seed, hot_rows):
    source, target = _random_pair(spark, seed, 400 if hot_rows > 3 else 900)
    for options in (DiffOptions(("k",), tolerance=1e-3, hot_rows=hot_rows), DiffOptions(("k", "v"), tolerance=1e-3, target_values=True, hot_rows=hot_rows)):
        found, each = diff(source, target, options), diff(source, target, options)
        each.one_pass = None
        assert found.changes().columns == each.changes().columns
        assert str(rows(found.changes())) == str(rows(each.changes()))
        s = found.summary()
        kinds = {r[0]: r[1] for r in found.changes().groupBy("_change_type").count().collect()}
        assert kinds == {k: v for k, v in (("added", s.added), ("deleted", s.deleted), ("modified", s.modified)) if v}


def test_one_pass_of_sides_with_other_columns_and_orders(spark):
    """Columns in another order, and some of one side only: which row is last follows each side's own columns."""
    rng = random.Random(8)
    source = spark.createDataFrame([(rng.randrange(20), rng.randrange(3), rng.randrange(3), "s") for _ in range(150)], "k int, a int, b int, mine string")
    target = spark.createDataFrame([(rng.randrange(3), 1.5, rng.randrange(3), rng.randrange(20)) for _ in range(150)], "b int, more double, a int, k int")
    for options in (DiffOptions(("k",), ignore=("mine",)), DiffOptions(("k",), target_values=True), DiffOptions(("k",), order_by=("b", "a"), ignore=("mine",))):
        found, each = diff(source, target, options), diff(source, target, options)
        each.one_pass = None
        assert str(rows(found.changes())) == str(rows(each.changes()))


def test_one_pass_shuffles_each_side_once(spark):
    a, b = _random_pair(spark, 3)
    found = diff(a, b, DiffOptions(("k",)))
    plan = found.changes()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sketch_names_hot_keys_and_no_others(spark):
    side = Side(spark.sql("SELECT if(id % 3 = 0, -1, id) AS k FROM range(30000)"), "s", ["k"], "typed", (), False)
    hot = hot_keys([side], 1000)
    want = side.rows.where("s0 = -1").select(key_hash(side)).first()[0]
    assert hot == [want] and hot_keys([side], 20_000) == []
    assert hot_keys([side.where(F.lit(False)), side.where(F.lit(False))], 10) == []


def test_checksums_leave_out_equal_rows_only(spark):
    source = spark.sql("SELECT id, cast(id % 5 AS string) AS v, cast(id AS double) AS w FROM range(50000)")
    target = source.where("id <> 7").withColumn("w", F.when(F.col("id") == 123, F.col("w") + 1).when(F.col("id") == 456, F.col("w") * (1 + 1e-9)).otherwise(F.col("w")))
    target = target.unionByName(spark.sql("SELECT 90000L AS id, 'x' AS v, 1D AS w"))
    for unique in (True, False):
        plain, found = (diff(source, target, DiffOptions(("id",), tolerance=1e-4, unique_keys=unique, checksums=c)) for c in (False, True))
        assert found.summary() == plain.summary() and (found.summary().added, found.summary().deleted, found.summary().modified) == (1, 1, 1)
        assert rows(found.changes()) == rows(plain.changes()) and rows(found.modified) == rows(plain.modified)
        first, last = found.checksum_levels[0], found.checksum_levels[-1]
        assert first.differing == 4 and last.source_rows + last.target_rows < 200
        # rows of equal buckets do not reach the shuffle
        plan = found.modified._jdf.queryExecution().executedPlan().toString()
        assert plan.count("IN (") + plan.count("INSET") >= 2
    same = diff(source, source, DiffOptions(("id",), checksums=True))
    assert same.checksum_levels[0].differing == 0 and same.summary().total_target == 50000 and same.changes().isEmpty()


def test_checksums_see_moved_nulls_and_repeats(spark):
    schema = "k int, a int, b int, l array<int>"
    source = spark.createDataFrame([(1, None, 5, [1, None]), (2, 1, 1, [2]), (3, 0, 0, None), (3, 0, 0, None)], schema)
    target = spark.createDataFrame([(1, 5, None, [None, 1]), (2, 1, 1, [2]), (3, 0, 0, None)], schema)
    found = diff(source, target, DiffOptions(("k",), checksums=True))
    s = found.summary()
    assert (s.total_source, s.total_target, s.modified, s.columns) == (4, 3, 1, {"a": 1, "b": 1, "l": 1})
    assert diff(source, target.drop("b"), DiffOptions(("k",), checksums=True)).checksum_levels == ()


@pytest.mark.parametrize("seed", [5, 6])
def test_checksums_of_random_pairs(spark, seed):
    source, target = _random_pair(spark, seed)
    options = DiffOptions(("k",), tolerance=1e-3, checksums=True)
    assert diff(source, target, options).summary() == diff(source, target, dataclasses.replace(options, checksums=False)).summary()


def test_checksum_tree_goes_down_into_differing_buckets(spark):
    source = spark.sql("SELECT id, id AS v FROM range(20000)")
    target = source.withColumn("v", F.when(F.col("id") % 4000 == 0, -1).otherwise(F.col("v")))
    s, t = (Side(df, tag, ["id"], "typed", (), True) for df, tag in ((source, "s"), (target, "t")))
    assert [x.buckets for x in narrow(s, t, ["v"], first=8, small=4).levels] == [8, 128]
    found = narrow(s, t, ["v"], first=8, small=4, enough=0)
    assert [x.buckets for x in found.levels] == [8, 128, 2048, 32768]
    assert found.levels[0].differing <= 5 and found.levels[-1].differing == 5
    assert [x.source_rows for x in found.levels] == sorted([x.source_rows for x in found.levels], reverse=True)
    assert found.source.count() + found.skipped == 20000 and found.source.count() == found.levels[-1].source_rows


def test_order_key_is_the_order_of_rows(spark):
    from rowdelta.functions.order_key import order_key

    kinds = "b boolean, y tinyint, h smallint, i int, l bigint, d date, t timestamp, n timestamp_ntz, m decimal(7,2), w double, s string"
    low, high = -(1 << 63), (1 << 63) - 1
    day, at = dt.date, dt.datetime
    columns = {
        "b": [None, False, True], "y": [None, -128, 0, 127], "h": [None, -32768, 5, 32767], "i": [None, -(1 << 31), -1, 0, (1 << 31) - 1], "l": [None, low, -1, 0, high],
        "d": [None, day(1, 1, 1), day(1969, 12, 31), day(9999, 12, 31)], "t": [None, at(1950, 1, 1, 0, 0, 0, 1), at(1970, 1, 1), at(2020, 5, 5, 1, 1, 1, 999999)],
        "n": [None, at(1950, 1, 1, 0, 0, 0, 1), at(1970, 1, 1), at(2020, 3, 29, 2, 30)], "m": [None, Decimal("-99999.99"), Decimal("-0.01"), Decimal("0"), Decimal("99999.99")],
        "w": [None, float("-inf"), -1.5, 2.0, float("inf")],
    }
    fields = {f.name: f.dataType for f in spark.createDataFrame([], kinds).schema.fields}
    for names in ("bi", "di", "ih", "dm", "mi", "yhb", "dhby", "l", "t", "n", "m", "w", "b"):
        names = names if names != "di" else "dy"
        values = list(itertools.product(*[columns[c] for c in names]))
        df = spark.createDataFrame(values, ", ".join(f"c{i} {fields[c].simpleString()}" for i, c in enumerate(names)))
        key = order_key([F.col(c) for c in df.columns], [f.dataType for f in df.schema.fields])
        assert [tuple(r)[:-1] for r in df.withColumn("key", key).orderBy("key").collect()] == values
        assert df.select(key.alias("key")).distinct().count() == len(values)
    for names in ("ii", "lb", "s", "bs", "wb", "tb", ""):
        assert order_key([F.col(c) for c in names], [fields[c] for c in names]) is None


@pytest.mark.parametrize("order", [("o",), ("d", "h"), ("w",)])
def test_last_row_by_one_value_where_orders_are_null(spark, order):
    """Keys whose rows all have a null order, and values that are null in the last row, agree with the window's last row."""
    rng = random.Random(4)
    orders = [None, *range(40)]

    def side():
        rows = []
        for k in range(40):
            for o in rng.sample(orders, 3) if k % 4 else [None]:
                day = None if o is None else dt.date(2020, 1, 1) + dt.timedelta(days=o // 7)
                rows.append((k, o, day, None if o is None else o % 7, None if o is None else float(o), rng.choice([None, "a"]), rng.choice([None, 1])))
        return spark.createDataFrame(rows, "k int, o bigint, d date, h smallint, w double, v string, x int")

    found = diff(side(), side(), DiffOptions(("k",), order_by=order, ignore=tuple({"o", "d", "h", "w"} - set(order))))
    assert found.summary().modified == found.modified.count() > 0
    for c, n in found.summary().columns.items():
        assert found.modified.where(f"_modified_{c}").count() == n
    assert "SortAggregate" not in found.summary_frame._jdf.queryExecution().executedPlan().toString()


def test_packed_order_is_a_hash_aggregate_and_the_same_result(spark):
    schema = "k int, o int, d date, v string, l array<int>, w double"
    rng = random.Random(9)
    side = lambda: spark.createDataFrame([(rng.randrange(30), i, rng.choice([None, dt.date(2020, 1, rng.randrange(1, 28))]), rng.choice([None, "a", "b"]), rng.choice([None, [1, None], [None, 1]]), rng.random()) for i in rng.sample(range(500), 200)], schema)
    a, b = side(), side()
    a, b = (x.withColumn("o", F.col("o").cast("smallint")) for x in (a, b))
    packed = diff(a, b, DiffOptions(("k",), order_by=("d", "o"), tolerance=0.2))
    plain = diff(*[x.withColumn("s", F.col("o").cast("double")) for x in (a, b)], DiffOptions(("k",), order_by=("d", "s"), ignore=("s",), tolerance=0.2))
    assert packed.summary() == plain.summary() and packed.summary().modified == packed.modified.count() > 0
    plans = [x.summary_frame._jdf.queryExecution().executedPlan().toString() for x in (packed, plain)]
    assert "SortAggregate" not in plans[0] and "SortAggregate" in plans[1]


@pytest.mark.parametrize("order", [("o",), ("o", "w"), ("x", "o"), ("text",)])
def test_rows_that_an_order_leaves_equal_are_chosen_alike_on_both_sides(spark, order):
    """The same rows in another sequence differ in nothing, whichever plan finds a key's last row."""
    rng = random.Random(5)
    made = [(k, 7, 1.5, "t", i % 2, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for k in range(20) for i in range(5)]
    schema = "k int, o int, w double, text string, x int, v string, y bigint"
    a, b = (spark.createDataFrame(m, schema).coalesce(1) for m in (made, made[::-1]))
    b = b.select("y", "v", *[c for c in b.columns if c not in ("y", "v")])
    found = diff(a, b, DiffOptions(("k",), order_by=order))
    assert (found.summary().modified, found.modified.count(), found.changes().count()) == (0, 0, 0)
    # what both sides do not share decides last: which row is shown does not depend on the sequence
    a, b = (x.withColumn("mine", F.concat("v", F.lit("!"))) for x in (a, b))
    shown = [rows(diff(x, y.drop("mine"), DiffOptions(("k",), order_by=order)).modified) for x, y in ((a, b), (b.select(*a.columns), a))]
    assert shown[0] == shown[1] and len(shown[0]) == 20
