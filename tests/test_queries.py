import os
import shutil

import duckdb
import pytest

from rowdelta.queries import FIXED_DIR, ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return "NaN" if isinstance(v, float) and v != v else v


@pytest.mark.filterwarnings("ignore:no key columns")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()]
    assert got
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name].replace(FIXED_DIR, DATA))
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == sorted(df.columns)
        assert sorted(got, key=str) == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_known_counts(spark):
    """Expected values of the derived pairs at this scale."""
    assert tuple(QUERIES["diff_summary"](spark, DATA).first()) == (1411, 1363, 80, 128, 335)
    assert {r[0]: r[1] for r in QUERIES["diff_column_counts"](spark, DATA).collect()} == {"o_orderstatus": 99, "o_totalprice": 256}
    assert tuple(QUERIES["diff_duplicate_summary"](spark, DATA).first()) == (5637, 5441, 172, 293, 924)


def test_generated_pair_against_plain_python(spark):
    # the diff of the generated pair, row by row
    from rowdelta import generate

    config = generate.PairConfig(rows=1500, changed=0.25)
    a, b = ({r["id"]: r.asDict() for r in f(spark, config).collect()} for f in (generate.source, generate.target))
    want = {"total_source": len(a), "total_target": len(b), "added": len(b.keys() - a.keys()), "deleted": len(a.keys() - b.keys())}

    def off(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return x != y and abs(x - y) >= 1e-4 * (max(abs(x), abs(y)) if x and y else 1)
        return x != y

    common = [(a[k], b[k]) for k in a.keys() & b.keys()]
    names = [c for c in next(iter(a.values())) if c != "id"]
    columns = {c: sum(off(x[c], y[c]) for x, y in common) for c in names}
    want["modified"] = sum(any(off(x[c], y[c]) for c in names) for x, y in common)
    got = QUERIES["generated_pair_diff"](spark, DATA).collect()
    assert spark.read.parquet(f"{DATA}/orders.parquet").count() == 1500
    assert {k: got[0][k] for k in want} == want and {r["column"]: r["modifications"] for r in got} == columns


@pytest.mark.parametrize("name", ["source_declared_columns", "source_footers", "source_row_groups"])
def test_files_below_a_table_s_folder_are_told_of_too(spark, duck, tmp_path, name):
    """The SQL's pattern takes files of the folder itself; of tables in several files the query tells of each."""
    (tmp_path / "orders.parquet").mkdir()
    for table, to in (("nation", "nation.parquet"), ("orders", "orders.parquet/part-0.parquet"), ("customer", "orders.parquet/part-1.parquet")):
        shutil.copy(f"{DATA}/{table}.parquet", tmp_path / to)
    df = QUERIES[name](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()), key=str)
    few = duck.execute(ORACLE_SQL[name].replace(FIXED_DIR, str(tmp_path))).fetchall()
    assert 0 < len(few) < len(got)
    assert {r[sorted(df.columns).index("file")] for r in got} == {"nation.parquet", "part-0.parquet", "part-1.parquet"}
    wide = duck.execute(ORACLE_SQL[name].replace(f"{FIXED_DIR}/*.parquet", f"{tmp_path}/**/*.parquet"))
    order = sorted(range(len(wide.description)), key=lambda i: wide.description[i][0])
    assert got == sorted((tuple(r[i] for i in order) for r in wide.fetchall()), key=str)
