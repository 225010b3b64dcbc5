"""The registered queries of the comparison engine, each with DuckDB SQL where SQL can express it.

The tables have no nulls, so the compared pairs are derived from them: some rows leave either side and some
values change, become null, or move by less than a tolerance.
"""

from __future__ import annotations

import contextlib
import dataclasses
import io
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta import cli, generate, sinks, sources
from rowdelta.inspect import column_statistics
from rowdelta.model import Dataset, DiffOptions, DiffResult, FieldInfo, SchemaInfo
from rowdelta.plans import diff
from rowdelta.schema import (
    DecimalPrecisionRule,
    DictionaryEncodingRule,
    FieldTypeRule,
    MetadataRule,
    NullabilityRule,
    RequiredFieldsRule,
    TemporalFormatRule,
    TypeCompatibilityRule,
    ValidationLevel,
    Validator,
    parse_type,
    schema_text,
    validator_from_file,
)
from rowdelta.schema.data_checks import check_data
from rowdelta.schema.report import differences_frame
from rowdelta.schema.types import schema_of
from rowdelta.sources.footers import columns_of, disagreements, footers, row_groups
from rowdelta.streaming import diff_stream
from rowdelta.workers import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# orders: one key, unique

O_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
O_SOURCE = f"SELECT {O_COLS} FROM orders WHERE o_orderkey % 17 <> 0"
O_TARGET = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 100 WHEN o_orderkey % 7 = 0 THEN o_totalprice * CAST(1.00000001 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0"""
TOL = 1e-4


def _sql(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {name}", "FROM {t}"), t=_table(spark, sf_dir, name))


def _orders(spark: SparkSession, sf_dir: str, target: str = O_TARGET, source: str = O_SOURCE, **options) -> DiffResult:
    options = {"keys": ("o_orderkey",), "tolerance": TOL, "unique_keys": True} | options
    return diff(_sql(spark, sf_dir, "orders", source), _sql(spark, sf_dir, "orders", target), DiffOptions(**options))


def _near(a: str, b: str, tol: float = TOL) -> str:
    """Float equality in SQL."""
    return f"({a} = {b} OR CASE WHEN {a} = 0 OR {b} = 0 THEN abs({a} - {b}) < {tol}::DOUBLE ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) < {tol}::DOUBLE END)"


def _off(a: str, b: str, tol: float = TOL) -> str:
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN FALSE WHEN {a} IS NULL OR {b} IS NULL THEN TRUE ELSE NOT {_near(a, b, tol)} END)"


def _pair(source: str = O_SOURCE, target: str = O_TARGET) -> str:
    return f"WITH s AS ({source}), t AS ({target})"


FLAGS = {
    "o_custkey": "s.o_custkey IS DISTINCT FROM t.o_custkey",
    "o_orderstatus": "s.o_orderstatus IS DISTINCT FROM t.o_orderstatus",
    "o_totalprice": _off("s.o_totalprice", "t.o_totalprice"),
    "o_orderpriority": "s.o_orderpriority IS DISTINCT FROM t.o_orderpriority",
}


def _summary_sql(flags: dict[str, str], pair: str, keys: tuple[str, ...] = ("o_orderkey",)) -> str:
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    return f"""{pair} SELECT (SELECT count(*) FROM s) AS total_source, (SELECT count(*) FROM t) AS total_target,
      (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE {on})) AS added,
      (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE {on})) AS deleted,
      (SELECT count(*) FROM s JOIN t ON {on} WHERE {" OR ".join(flags.values())}) AS modified"""


def _modified_sql(flags: dict[str, str], pair: str, columns: list[str], keys: tuple[str, ...] = ("o_orderkey",)) -> str:
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    marks = ", ".join(f"{flags.get(c, 'FALSE')} AS _modified_{c}" for c in columns)
    return f"{pair} SELECT {', '.join('s.' + c for c in columns)}, {marks} FROM s JOIN t ON {on} WHERE {' OR '.join(flags.values())}"


COLS = O_COLS.split(", ")


@query(_summary_sql(FLAGS, _pair()))
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).summary_frame.drop("columns")


@query(f"{_pair()} SELECT t.* FROM t ANTI JOIN s USING (o_orderkey)")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).added


@query(f"{_pair()} SELECT s.* FROM s ANTI JOIN t USING (o_orderkey)")
def diff_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).deleted


@query(_modified_sql(FLAGS, _pair(), COLS))
def diff_modified_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).modified


@query(
    _pair()
    + " SELECT * FROM ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS modifications FROM s JOIN t USING (o_orderkey) WHERE {f}""" for c, f in FLAGS.items())
    + ") WHERE modifications > 0"
)
def diff_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).column_counts


@query(
    f"""{_pair()} SELECT 'added' AS _change_type, t.*, NULL::BOOLEAN AS _modified_o_orderkey, {", ".join(f"NULL::BOOLEAN AS _modified_{c}" for c in FLAGS)} FROM t ANTI JOIN s USING (o_orderkey)
  UNION ALL SELECT 'deleted', s.*, NULL, NULL, NULL, NULL, NULL FROM s ANTI JOIN t USING (o_orderkey)
  UNION ALL SELECT 'modified', s.*, FALSE, {", ".join(FLAGS.values())} FROM s JOIN t USING (o_orderkey) WHERE {" OR ".join(FLAGS.values())}"""
)
def diff_combined_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).changes()


EXACT = FLAGS | {"o_totalprice": "s.o_totalprice IS DISTINCT FROM t.o_totalprice"}


@query(_modified_sql(EXACT, _pair(), COLS))
def diff_tolerance_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, tolerance=0.0).modified


WIDE = FLAGS | {"o_totalprice": _off("s.o_totalprice", "t.o_totalprice", 0.01)}


@query(_modified_sql(WIDE, _pair(), COLS))
def diff_tolerance_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, tolerance=0.01).modified


Z_SOURCE = "SELECT o_orderkey, CAST(0 AS DOUBLE) AS v FROM orders"
Z_TARGET = "SELECT o_orderkey, CAST(o_orderkey % 4 AS DOUBLE) * CAST(0.00005 AS DOUBLE) AS v FROM orders"


@query(_modified_sql({"v": _off("s.v", "t.v")}, _pair(Z_SOURCE, Z_TARGET), ["o_orderkey", "v"]))
def diff_tolerance_absolute_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, Z_TARGET, Z_SOURCE).modified


def _odd(shift: int) -> str:
    return f"""SELECT o_orderkey, CASE (o_orderkey + {shift} * CAST(floor(o_orderkey / 6) AS BIGINT)) % 6 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE)
      WHEN 3 THEN NULL WHEN 4 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS v FROM orders"""


@query(
    f"""{_pair(_odd(0), _odd(1))} SELECT o_orderkey, FALSE AS _modified_o_orderkey, f AS _modified_v
    FROM (SELECT s.o_orderkey, {_off("s.v", "t.v")} AS f FROM s JOIN t USING (o_orderkey)) WHERE f"""
)
def diff_nan_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, _odd(1), _odd(0)).modified.drop("v")


# null keys: one key column is null on both sides for some rows, one side for others

N_SOURCE = "SELECT CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS k1, o_orderkey AS k2, o_custkey AS v FROM orders WHERE o_orderkey % 17 <> 0"
N_TARGET = "SELECT CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS k1, o_orderkey AS k2, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 11 <> 0"


@query(_summary_sql({"v": "s.v IS DISTINCT FROM t.v"}, _pair(N_SOURCE, N_TARGET), ("k1", "k2")))
def diff_null_safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, N_TARGET, N_SOURCE, keys=("k1", "k2")).summary_frame.drop("columns")


V_SOURCE = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS b FROM orders"
V_TARGET = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS b FROM orders"


@query(_modified_sql({"a": "s.a IS DISTINCT FROM t.a", "b": _off("s.b", "t.b")}, _pair(V_SOURCE, V_TARGET), ["o_orderkey", "a", "b"]))
def diff_null_vs_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, V_TARGET, V_SOURCE).modified


@query(_modified_sql({k: v for k, v in FLAGS.items() if k != "o_totalprice"}, _pair(), COLS))
def diff_ignore_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, ignore=("o_totalprice",)).modified


X_TARGET = O_TARGET.replace("o_orderpriority FROM", "o_orderpriority, o_custkey * 2 AS extra FROM")


@query(_modified_sql(FLAGS, _pair(O_SOURCE, X_TARGET), COLS))
def diff_target_extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, X_TARGET).modified


M_TARGET = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0"


@query(f"{_pair(O_SOURCE, M_TARGET)} SELECT s.*, FALSE AS _modified_o_orderkey, FALSE AS _modified_o_custkey, FALSE AS _modified_o_orderstatus, FALSE AS _modified_o_totalprice, TRUE AS _modified_o_orderpriority FROM s SEMI JOIN t USING (o_orderkey)")
def diff_target_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, M_TARGET).modified


W_SOURCE = "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0"
W_TARGET = "SELECT o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0"
_whole = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in ("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    f"""{_pair(W_SOURCE, W_TARGET)} SELECT (SELECT count(*) FROM s) AS total_source, (SELECT count(*) FROM t) AS total_target,
      (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_whole})) AS added, (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE {_whole})) AS deleted, 0::BIGINT AS modified"""
)
def diff_no_keys_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, W_TARGET, W_SOURCE, keys=(), unique_keys=False).summary_frame.drop("columns")


@query(f"{_pair(W_SOURCE, W_TARGET)} SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_whole})")
def diff_no_keys_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, W_TARGET, W_SOURCE, keys=(), unique_keys=False).added


_text = lambda a: f"coalesce(CAST({a}.k1 AS VARCHAR), 'NULL') || '|' || coalesce(CAST({a}.k2 AS VARCHAR), 'NULL')"


@query(
    f"""{_pair(N_SOURCE, N_TARGET)} SELECT t.* FROM t WHERE {_text("t")} NOT IN (SELECT {_text("s")} FROM s)"""
)
def diff_legacy_string_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, N_TARGET, N_SOURCE, keys=("k1", "k2"), key_style="text").added


@query("SELECT count(*) AS total_source, count(*) AS total_target, 0::BIGINT AS added, 0::BIGINT AS deleted, 0::BIGINT AS modified FROM orders")
def diff_identical_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "SELECT * FROM orders"
    return _orders(spark, sf_dir, same, same).summary_frame.drop("columns")


@query(_modified_sql(FLAGS, _pair(), COLS).replace(" FROM s JOIN t", ", " + ", ".join(f"t.{c} AS _target_{c}" for c in COLS) + " FROM s JOIN t"))
def diff_target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, target_values=True).modified


# lineitem: two keys, several rows a key

L_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
L_SOURCE = f"SELECT {', '.join(L_COLS)} FROM lineitem WHERE l_partkey % 17 <> 0"
L_TARGET = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS l_quantity, l_returnflag FROM lineitem WHERE l_partkey % 11 <> 0"
L_KEYS, L_ORDER = ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
_last = "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC) = 1"
L_FLAGS = {"l_partkey": "s.l_partkey <> t.l_partkey", "l_suppkey": "s.l_suppkey <> t.l_suppkey", "l_quantity": _off("s.l_quantity", "t.l_quantity"), "l_returnflag": "s.l_returnflag <> t.l_returnflag"}


def _lineitem(spark: SparkSession, sf_dir: str) -> DiffResult:
    options = DiffOptions(L_KEYS, tolerance=TOL, order_by=L_ORDER)
    return diff(_sql(spark, sf_dir, "lineitem", L_SOURCE), _sql(spark, sf_dir, "lineitem", L_TARGET), options)


_l_last = f"WITH s0 AS ({L_SOURCE}), t0 AS ({L_TARGET}), s AS (SELECT * FROM s0 {_last}), t AS (SELECT * FROM t0 {_last})"


@query(_modified_sql(L_FLAGS, _l_last, L_COLS, L_KEYS))
def diff_compound_key_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).modified


@query(f"WITH s AS ({L_SOURCE}), t AS ({L_TARGET}) SELECT t.* FROM t ANTI JOIN s USING (l_orderkey, l_linenumber)")
def diff_duplicate_added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).added


@query(f"WITH s AS ({L_SOURCE}), t AS ({L_TARGET}) SELECT s.* FROM s ANTI JOIN t USING (l_orderkey, l_linenumber)")
def diff_duplicate_deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).deleted


@query(
    f"""{_l_last} SELECT (SELECT count(*) FROM s0) AS total_source, (SELECT count(*) FROM t0) AS total_target,
      (SELECT count(*) FROM t0 ANTI JOIN s USING (l_orderkey, l_linenumber)) AS added, (SELECT count(*) FROM s0 ANTI JOIN t USING (l_orderkey, l_linenumber)) AS deleted,
      (SELECT count(*) FROM s JOIN t USING (l_orderkey, l_linenumber) WHERE {" OR ".join(L_FLAGS.values())}) AS modified"""
)
def diff_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).summary_frame.drop("columns")


_l_both = "JOIN t USING (l_orderkey, l_linenumber)"
_l_none = ", ".join(f"NULL::BOOLEAN AS _modified_{c}" for c in L_COLS)


@query(
    f"""{_l_last} SELECT 'added' AS _change_type, t0.*, {_l_none} FROM t0 ANTI JOIN s USING (l_orderkey, l_linenumber)
  UNION ALL SELECT 'deleted', s0.*, {", ".join(["NULL"] * len(L_COLS))} FROM s0 ANTI JOIN t USING (l_orderkey, l_linenumber)
  UNION ALL SELECT 'modified', {", ".join("s." + c for c in L_COLS)}, FALSE, FALSE, {", ".join(L_FLAGS.values())} FROM s {_l_both} WHERE {" OR ".join(L_FLAGS.values())}"""
)
def diff_repeated_keys_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of several rows: all changes from one shuffle of both sides."""
    return _lineitem(spark, sf_dir).changes()


# a few hot keys hold all rows

H_SOURCE = "SELECT l_suppkey % 7 AS k, l_orderkey * 10 + l_linenumber AS o, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey % 7 <> 5"
H_TARGET = "SELECT l_suppkey % 7 AS k, l_orderkey * 10 + l_linenumber AS o, l_partkey, l_suppkey, l_quantity + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS l_quantity FROM lineitem WHERE l_suppkey % 7 <> 6"
_h_last = "QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"
_h_pair = f"WITH s0 AS ({H_SOURCE}), t0 AS ({H_TARGET}), s AS (SELECT * FROM s0 {_h_last}), t AS (SELECT * FROM t0 {_h_last})"
_h_off = f"s.o <> t.o OR s.l_partkey <> t.l_partkey OR s.l_suppkey <> t.l_suppkey OR {_off('s.l_quantity', 't.l_quantity')}"


@query(
    f"""{_h_pair} SELECT 'added' AS _change_type, t0.* FROM t0 ANTI JOIN s USING (k) UNION ALL SELECT 'deleted', s0.* FROM s0 ANTI JOIN t USING (k)
  UNION ALL SELECT 'modified', s.* FROM s JOIN t USING (k) WHERE {_h_off}"""
)
def diff_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven keys hold all rows: a sketch finds them, and joins spread their rows."""
    options = DiffOptions(("k",), tolerance=TOL, order_by=("o", "l_partkey", "l_suppkey", "l_quantity"), hot_rows=1000)
    found = diff(_sql(spark, sf_dir, "lineitem", H_SOURCE), _sql(spark, sf_dir, "lineitem", H_TARGET), options)
    return found.changes().select("_change_type", "k", "o", "l_partkey", "l_suppkey", "l_quantity")


# the last row of a key by one column

P_SOURCE = "SELECT l_orderkey, l_partkey * 1000 + l_linenumber AS place, l_shipdate, l_suppkey, l_quantity, l_returnflag FROM lineitem WHERE l_partkey % 17 <> 0"
P_TARGET = "SELECT l_orderkey, l_partkey * 1000 + l_linenumber AS place, l_shipdate, l_suppkey, l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS l_quantity, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN '?' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_partkey % 11 <> 0"
_p_last = "QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY place DESC) = 1"
_p_pair = f"WITH s0 AS ({P_SOURCE}), t0 AS ({P_TARGET}), s AS (SELECT * FROM s0 {_p_last}), t AS (SELECT * FROM t0 {_p_last})"
_p_flags = {"place": "s.place <> t.place", "l_shipdate": "s.l_shipdate <> t.l_shipdate", "l_suppkey": "s.l_suppkey <> t.l_suppkey", "l_quantity": _off("s.l_quantity", "t.l_quantity"), "l_returnflag": "s.l_returnflag IS DISTINCT FROM t.l_returnflag"}


@query(
    f"""{_p_pair} SELECT (SELECT count(*) FROM s0) AS total_source, (SELECT count(*) FROM t0) AS total_target,
      (SELECT count(*) FROM t0 ANTI JOIN s USING (l_orderkey)) AS added, (SELECT count(*) FROM s0 ANTI JOIN t USING (l_orderkey)) AS deleted,
      (SELECT count(*) FROM s JOIN t USING (l_orderkey) WHERE {" OR ".join(_p_flags.values())}) AS modified, {", ".join(f"(SELECT count(*) FROM s JOIN t USING (l_orderkey) WHERE {f}) AS by_{c}" for c, f in _p_flags.items())}"""
)
def diff_last_wins_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a key by one number, of equal ones that by the other columns; a hash aggregate counts a key's rows."""
    options = DiffOptions(("l_orderkey",), tolerance=TOL, order_by=("place",))
    found = diff(_sql(spark, sf_dir, "lineitem", P_SOURCE), _sql(spark, sf_dir, "lineitem", P_TARGET), options).summary_frame
    return found.select("*", *[F.col("columns")[c].alias(f"by_{c}") for c in _p_flags]).drop("columns")


# a few changes among many equal rows: checksums leave out the buckets of the others

C_SOURCE = f"SELECT {O_COLS} FROM orders WHERE o_orderkey % 199 <> 0"
C_TARGET = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 401 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 307 = 0 THEN o_totalprice + 100 WHEN o_orderkey % 311 = 0 THEN o_totalprice * CAST(1.00000001 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  o_orderpriority FROM orders WHERE o_orderkey % 211 <> 0"""


@query(_summary_sql(FLAGS, _pair(C_SOURCE, C_TARGET)))
def diff_checksum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, C_TARGET, C_SOURCE, checksums=True).summary_frame.drop("columns")


@query(
    f"""{_pair(C_SOURCE, C_TARGET)} SELECT 'added' AS _change_type, t.* FROM t ANTI JOIN s USING (o_orderkey) UNION ALL SELECT 'deleted', s.* FROM s ANTI JOIN t USING (o_orderkey)
  UNION ALL SELECT 'modified', s.* FROM s JOIN t USING (o_orderkey) WHERE {" OR ".join(FLAGS.values())}"""
)
def diff_checksum_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, C_TARGET, C_SOURCE, checksums=True).changes().select("_change_type", *COLS)


# other column types

E_SOURCE = "SELECT event_id, ts, event_type FROM events"
E_TARGET = "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 1 SECOND WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts, event_type FROM events WHERE event_id % 9 <> 0"


@query(f"WITH s AS ({E_SOURCE}), t AS ({E_TARGET}) SELECT s.event_id, s.event_type, FALSE AS _modified_event_id, TRUE AS _modified_ts, FALSE AS _modified_event_type FROM s JOIN t USING (event_id) WHERE s.ts IS DISTINCT FROM t.ts")
def diff_timestamp_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lambda q: _sql(spark, sf_dir, "events", q)
    return diff(events(E_SOURCE), events(E_TARGET), DiffOptions(("event_id",), unique_keys=True)).modified.drop("ts")


@query(
    """WITH t AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding, label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS label FROM embeddings)
  SELECT s.vec_id, s.label, FALSE AS _modified_vec_id, s.embedding IS DISTINCT FROM t.embedding AS _modified_embedding, s.label IS DISTINCT FROM t.label AS _modified_label
  FROM embeddings s JOIN t USING (vec_id) WHERE s.embedding IS DISTINCT FROM t.embedding OR s.label IS DISTINCT FROM t.label"""
)
def diff_array_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 3 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    label = F.when(F.col("vec_id") % 4 == 0, F.col("label") + 1).otherwise(F.col("label"))
    target = source.select("vec_id", changed.alias("embedding"), label.alias("label"))
    return diff(source, target, DiffOptions(("vec_id",), unique_keys=True)).modified.drop("embedding")


D_SOURCE = "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12, 2)) AS price FROM part"
D_TARGET = "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) + CASE WHEN p_partkey % 8 = 0 THEN CAST(0.01 AS DECIMAL(12, 2)) ELSE CAST(0 AS DECIMAL(12, 2)) END AS DECIMAL(12, 2)) AS price FROM part"


@query(f"WITH s AS ({D_SOURCE}), t AS ({D_TARGET}) SELECT s.p_partkey, CAST(s.price AS DOUBLE) AS price, FALSE AS _modified_p_partkey, TRUE AS _modified_price FROM s JOIN t USING (p_partkey) WHERE s.price <> t.price")
def diff_decimal_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda q: _sql(spark, sf_dir, "part", q)
    out = diff(part(D_SOURCE), part(D_TARGET), DiffOptions(("p_partkey",), tolerance=1.0, unique_keys=True)).modified
    return out.withColumn("price", F.col("price").cast("double"))


@query(
    """WITH s AS (SELECT c_custkey, [{'k': 'a', 'v': c_name}, {'k': 'b', 'v': c_mktsegment}] AS tags FROM customer),
  t AS (SELECT c_custkey, [{'k': 'b', 'v': c_mktsegment}, {'k': 'a', 'v': CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE c_name END}] AS tags FROM customer)
  SELECT c_custkey, FALSE AS _modified_c_custkey, TRUE AS _modified_tags FROM s JOIN t USING (c_custkey) WHERE list_sort(s.tags) IS DISTINCT FROM list_sort(t.tags)"""
)
def diff_map_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("a"), "c_name", F.lit("b"), "c_mktsegment").alias("tags"))
    other = F.when(F.col("c_custkey") % 5 == 0, F.lit("?")).otherwise(F.col("c_name"))
    target = _table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("b"), "c_mktsegment", F.lit("a"), other).alias("tags"))
    return diff(source, target, DiffOptions(("c_custkey",), unique_keys=True)).modified.drop("tags")


# sources and sinks: a round trip through the shared folder compared with what went in


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    path = path.removeprefix("file://").removeprefix("file:")
    return path


S_COLS = "s_suppkey, s_name, s_nationkey, s_acctbal"


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def source_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + ".csv"
    name = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("s_name")
    _table(spark, sf_dir, "supplier").select("s_suppkey", name, "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    return sources.read(spark, path).df


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal FROM customer")
def source_arrow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + ".arrow"
    name = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name")
    sinks.write(_table(spark, sf_dir, "customer").select("c_custkey", name, "c_acctbal"), path, "arrow")
    return sources.read(spark, path).df


@query("SELECT * FROM customer")
def sink_arrow_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + ".arrow"
    sinks.write_arrow_folder(_table(spark, sf_dir, "customer"), path)
    return sources.read(spark, path, "arrow").df


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def sink_parquet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + ".parquet"
    sinks.write(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), path, "parquet")
    return sources.read(spark, path).df


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS s_name, s_acctbal FROM supplier")
def sink_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + ".json"
    name = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("s_name")
    sinks.write(_table(spark, sf_dir, "supplier").select("s_suppkey", name, "s_acctbal"), path, "json")
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(path)


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
FIXED_DIR = "/root/testdata/sf0.01"


@query(
    f"""SELECT parse_filename(file_name) AS file, row_group_id::BIGINT AS row_group, row_group_num_rows::BIGINT AS group_rows, replace(path_in_schema, ', ', '.') AS "column", type, num_values::BIGINT AS n_values,
      stats_null_count::BIGINT AS nulls, CASE WHEN type = 'INT32' OR type = 'BYTE_ARRAY' AND path_in_schema NOT IN ('text', 'html') THEN stats_min_value END AS least,
      CASE WHEN type = 'INT32' OR type = 'BYTE_ARRAY' AND path_in_schema NOT IN ('text', 'html') THEN stats_max_value END AS greatest,
      compression, total_compressed_size::BIGINT AS compressed, total_uncompressed_size::BIGINT AS uncompressed
    FROM parquet_metadata('{FIXED_DIR}/*.parquet')"""
)
def source_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the footers of all tables say of each column of each row group; bounds of small numbers and of short text,
    since readers differ in how they show times and in whether they give long bounds."""
    found = row_groups(spark, sf_dir)
    shown = (F.col("type") == "INT32") | ((F.col("type") == "BYTE_ARRAY") & ~F.col("column").isin("text", "html"))
    names = {"least": F.when(shown, F.col("least")), "greatest": F.when(shown, F.col("greatest")), "file": F.regexp_extract("file", "[^/]*$", 0)}
    return found.withColumns(names)


@query(f"SELECT parse_filename(file_name) AS file, file_size_bytes::BIGINT AS bytes, num_rows::BIGINT AS \"rows\", num_row_groups::BIGINT AS row_groups, created_by FROM parquet_file_metadata('{FIXED_DIR}/*.parquet')")
def source_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footers(spark, sf_dir).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "bytes", "rows", "row_groups", "created_by")


@query(
    f"""SELECT parse_filename(file_name) AS file, name AS "column", repetition_type = 'OPTIONAL' AS nullable, row_number() OVER (PARTITION BY file_name ORDER BY column_id) - 1 AS place
    FROM (SELECT *, sum(CASE WHEN num_children IS NOT NULL AND name <> 'schema' THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY column_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM parquet_schema('{FIXED_DIR}/*.parquet'))
    WHERE name NOT IN ('schema', 'list', 'element') """
)
def source_declared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-level columns that each file of the tables declares."""
    return columns_of(footers(spark, sf_dir)).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "column", "nullable", "place")


@query(
    """SELECT 's_acctbal' AS "column", 'missing' AS fact, NULL AS value, count(DISTINCT s_nationkey % 3) AS n_files FROM supplier WHERE s_nationkey % 3 = 1
  UNION ALL SELECT 's_name', 'nullable', 'false', count(DISTINCT s_nationkey % 3) FROM supplier WHERE s_nationkey % 3 = 2
  UNION ALL SELECT 's_name', 'nullable', 'true', count(DISTINCT s_nationkey % 3) FROM supplier WHERE s_nationkey % 3 <> 2"""
)
def schema_files_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in three parts, of which one lacks a column and one declares another without nulls."""
    path = _folder(spark) + ".parquet"
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", (F.col("s_nationkey") % 3).alias("part"))
    strict = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType(), False), T.StructField("s_acctbal", T.DoubleType())])
    for part in range(3):
        own = rows.where(F.col("part") == part).drop("part", *(["s_acctbal"] if part == 1 else [])).coalesce(1)
        if part == 2:
            own = own.select("s_suppkey", F.coalesce("s_name", F.lit("")).alias("s_name"), "s_acctbal").mapInArrow(lambda batches: batches, strict)
        sinks.write_files(own, f"{path}/{part}", "parquet")
    return disagreements(footers(spark, path)).drop("example")


@query(
    f"""{_pair()}, c AS (SELECT 'added' AS _change_type, count(*) AS "rows" FROM t ANTI JOIN s USING (o_orderkey) UNION ALL SELECT 'deleted', count(*) FROM s ANTI JOIN t USING (o_orderkey)
      UNION ALL SELECT 'modified', count(*) FROM s JOIN t USING (o_orderkey) WHERE {" OR ".join(FLAGS.values())})
    SELECT c.*, 'true' AS modified_record, TRUE AS dated FROM c"""
)
def diff_footer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined output's own footers: rows of each kind, and the metadata that each file has."""
    path = _folder(spark) + ".parquet"
    sinks.write_diff(_orders(spark, sf_dir), path)
    found = footers(spark, path).withColumn("_change_type", F.regexp_extract("file", "_change_type=([a-z]+)/", 1))
    own = F.col("metadata")
    return found.groupBy("_change_type").agg(F.sum("rows").alias("rows"), F.max(own["modified_record"]).alias("modified_record"), F.every(F.to_timestamp(own["modification_time"]).isNotNull()).alias("dated"))


def _one_file(spark: SparkSession, df: DataFrame, kind: str) -> str:
    path = f"{_local(_folder(spark))}.{kind.split('_')[0]}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    sinks.write(df, path, kind)
    return path


@query("SELECT * FROM nation")
def sink_arrow_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read(spark, _one_file(spark, _table(spark, sf_dir, "nation"), "arrow_file")).df


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def sink_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _one_file(spark, _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "json_array")
    return spark.read.schema("n_nationkey long, n_name string").json(path, multiLine=True)


@query("SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def source_database_even_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through a database, read back in parts of about as many rows.

    In a local session it is the one that Spark brings along, by JDBC. That serves one process, so where executors are
    others it is a file that all of them open."""
    priority = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", priority)
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        path = _folder(spark) + ".sqlite"
        sources.write_sqlite(rows, path, "orders", index="o_custkey")
        return sources.read(spark, path, "sqlite", table="orders", even=("o_custkey", 8)).df
    os.makedirs(_local(shared_dir(spark)), exist_ok=True)
    url = f"jdbc:derby:{_local(_folder(spark))};create=true"
    rows.write.format("jdbc").option("url", url).option("dbtable", "orders").option("driver", DERBY).save()
    return sources.read(spark, url, "jdbc", table="orders", even=("o_custkey", 8), driver=DERBY).df.toDF("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


# schemas: results are small and made on the driver


def _fields(**kinds: str) -> SchemaInfo:
    return SchemaInfo(tuple(FieldInfo(n, parse_type(k.rstrip("!")), not k.endswith("!")) for n, k in kinds.items()))


@query("SELECT * FROM (VALUES ('age', 'only_in_source', 'int32', NULL), ('email', 'only_in_target', NULL, 'string'), ('id', 'type', 'int64', 'int32'), ('name', 'nullability', 'true', 'false')) AS t(field, kind, source, target)")
def schema_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences_frame(spark, _fields(id="int64!", name="string", age="int32"), _fields(id="int32!", name="string!", email="string"))


def _result_rows(spark: SparkSession, results: list[tuple[str, object]]) -> DataFrame:
    rows = [(case, r.valid, kind, group, m) for case, r in results for kind, groups in (("error", r.errors), ("warning", r.warnings), ("outcome", {"": [""]})) for group, ms in groups.items() for m in ms]
    return spark.createDataFrame(rows, "case string, valid boolean, kind string, rule string, message string")


_message = """'lineitem' AS "case", FALSE AS valid, 'error' AS kind, {} AS rule, {} AS message"""
_columns = "(SELECT column_name AS n, column_type AS t FROM (DESCRIBE lineitem))"
#: Each rule again in SQL over the table's declared columns; what files declare beyond SQL (nullability, metadata,
#: encodings) is that of files written without any.
RULES_SQL = f"""
  SELECT 'lineitem' AS "case", FALSE AS valid, 'outcome' AS kind, '' AS rule, '' AS message
  UNION ALL SELECT {_message.format("'RequiredFieldsRule'", "'required fields missing: ' || string_agg(f, ', ' ORDER BY f)")} FROM (VALUES ('l_orderkey'), ('l_comment')) AS w(f) WHERE f NOT IN (SELECT n FROM {_columns})
  UNION ALL SELECT {_message.format("'NullabilityRule'", "'fields that should not be nullable: ' || n")} FROM {_columns} WHERE n = 'l_orderkey'
  UNION ALL SELECT {_message.format("'FieldTypeRule'", "'field type validation failed: field ''' || n || ''' has type ''' || lower(t) || ''', but expected one of: decimal128(12, 2)'")} FROM {_columns} WHERE n = 'l_quantity' AND t <> 'DECIMAL(12,2)'
  UNION ALL SELECT {_message.format("'TypeCompatibilityRule'", "'type compatibility validation failed: field ''' || n || ''' has type ''' || replace(t, 'INTEGER', 'int32') || ''' which is not in the compatibility map'")} FROM {_columns} WHERE n = 'l_linenumber' AND t <> 'BIGINT'
  UNION ALL SELECT {_message.format("'MetadataRule'", "'required metadata keys missing: owner'")}
  UNION ALL SELECT {_message.format("'DictionaryEncodingRule'", "'string fields should use dictionary encoding: ' || string_agg(n, ', ')")} FROM {_columns} WHERE t = 'VARCHAR' AND n <> 'l_linestatus'
  UNION ALL SELECT {_message.format("'TemporalFormatRule'", "'temporal format validation failed: ' || string_agg(m, '; ' ORDER BY m)")} FROM (
    SELECT 'field ''' || n || ''' should use Date32 type, got ''' || replace(t, 'VARCHAR', 'string') || '''' AS m FROM {_columns} WHERE n = 'l_returnflag' AND t <> 'DATE'
    UNION ALL SELECT 'field ''' || n || ''' should use timezone ''UTC'', got ''''' FROM {_columns} WHERE n = 'l_shipdate' AND t = 'TIMESTAMP')
  UNION ALL SELECT {_message.format("'DecimalPrecisionRule'", "'decimal precision validation failed: field ''' || n || ''' should be a decimal type, got ''' || lower(t) || ''''")} FROM {_columns} WHERE n = 'l_discount' AND t NOT LIKE 'DECIMAL%'
"""


@query(RULES_SQL)
def schema_rules_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the declared schema of lineitem."""
    info = sources.read(spark, f"{sf_dir}/lineitem.parquet", "parquet").schema
    rules = [
        RequiredFieldsRule(["l_orderkey", "l_comment"]),
        NullabilityRule(["l_orderkey"]),
        FieldTypeRule({"l_orderkey": [parse_type("int64")], "l_quantity": [parse_type("decimal(12,2)")]}),
        TypeCompatibilityRule({"l_tax": {parse_type("double"): [parse_type("double")]}, "l_linenumber": {parse_type("int64"): [parse_type("int64")]}}),
        MetadataRule(["owner"]),
        DictionaryEncodingRule(exempt=["l_linestatus"]),
        TemporalFormatRule(["l_shipdate"], ["l_returnflag"], "UTC"),
        DecimalPrecisionRule({"l_discount": (12, 2)}),
    ]
    return _result_rows(spark, [("lineitem", Validator(rules).validate(info))])


# rules held against rows: some values are lost, emptied or written as text

K_TABLE = """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN ' ' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS customer,
  o_totalprice / CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 1 END AS price, o_orderkey * 1000003 AS big,
  CASE WHEN o_orderkey % 11 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS day,
  CASE WHEN o_orderkey % 5 = 0 THEN '2024-01-01T10:00:00' ELSE '2024-01-01T10:00:00Z' END AS seen_at FROM orders"""
_k_asks = {
    ("RequiredFieldsRule", "status"): "status IS NULL OR trim(status) = ''",
    ("NullabilityRule", "status"): "status IS NULL",
    ("NullabilityRule", "o_orderkey"): "FALSE",
    ("FieldTypeRule", "customer"): "customer = 'n/a'",
    ("FieldTypeRule", "big"): "big > 2147483647",
    ("TemporalFormatRule", "day"): "day = '2024-02-30'",
    ("TemporalFormatRule", "seen_at"): "seen_at NOT LIKE '%Z'",
    ("DecimalPrecisionRule", "price"): "price <> round(price, 2)",
}


@query(
    f"WITH k AS ({K_TABLE.replace('AS STRING', 'AS VARCHAR')}) "
    + " UNION ALL ".join(f"""SELECT '{r}' AS rule, '{f}' AS field, count(*) AS "rows", count(*) FILTER (WHERE {c}) AS violations, '{{"o_orderkey":' || min(o_orderkey) FILTER (WHERE {c}) || '}}' AS first_key FROM k""" for (r, f), c in _k_asks.items())
)
def schema_data_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules over the rows of orders in one pass: how many values break each, and the first key."""
    rules = [
        RequiredFieldsRule(["status", "absent"]),
        NullabilityRule(["status", "o_orderkey"]),
        FieldTypeRule({"customer": [parse_type("int64")], "big": [parse_type("int32")]}),
        TemporalFormatRule(["seen_at"], ["day"], "UTC"),
        DecimalPrecisionRule({"price": (12, 2)}),
    ]
    return check_data(_sql(spark, sf_dir, "orders", K_TABLE), rules, ["o_orderkey"])


def _only(a: str, b: str) -> str:
    return f"(SELECT column_name AS n FROM (DESCRIBE {a}) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE {b})))"


_warning = "SELECT '{} tables', TRUE, 'warning', '{}', {} FROM {}"
#: What the levels say about the tables follows from their columns; about the fields below, from the levels' rules by hand.
LEVELS_SQL = f"""
  SELECT 'strict tables' AS "case", FALSE AS valid, 'error' AS kind, 'SchemaStructure' AS rule,
    (SELECT count(*) FROM (DESCRIBE customer)) || ' fields where the target has ' || (SELECT count(*) FROM (DESCRIBE supplier)) AS message
  UNION ALL {_warning.format("compatible", "SchemaEvolution", "'new field ''' || n || ''' in target schema'", _only("supplier", "customer"))}
  UNION ALL {_warning.format("compatible", "SchemaEvolution", "'field ''' || n || ''' removed in target schema'", _only("customer", "supplier"))}
  UNION ALL {_warning.format("relaxed", "SchemaStructure", "'field ''' || n || ''' exists only in target schema'", _only("supplier", "customer"))}
  UNION ALL {_warning.format("relaxed", "SchemaStructure", "'field ''' || n || ''' exists only in source schema'", _only("customer", "supplier"))}
  UNION ALL VALUES
  ('strict fields', FALSE, 'error', 'SchemaStructure', '''id'' forbids nulls where the target allows nulls; ''name'' allows nulls where the target forbids nulls; field type mismatch for ''age'': got ''int32'', expected ''int64'''),
  ('compatible fields', FALSE, 'error', 'SchemaCompatibility', '''name'' may be null, which the target forbids; incompatible type for field ''age'': got ''int32'', expected ''int64'''),
  ('compatible fields', FALSE, 'warning', 'SchemaEvolution', '''id'' may be null in the target only'),
  ('relaxed fields', FALSE, 'error', 'CommonFields', 'incompatible type for common field ''age'': got ''int32'', expected ''int64'''),
  ('strict tables', FALSE, 'outcome', '', ''), ('compatible tables', TRUE, 'outcome', '', ''), ('relaxed tables', TRUE, 'outcome', '', ''),
  ('strict fields', FALSE, 'outcome', '', ''), ('compatible fields', FALSE, 'outcome', '', ''), ('relaxed fields', FALSE, 'outcome', '', ''),
  ('strict same', TRUE, 'outcome', '', ''), ('compatible same', TRUE, 'outcome', '', ''), ('relaxed same', TRUE, 'outcome', '', '')
"""


@query(LEVELS_SQL)
def schema_levels_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level over the declared schemas of customer and supplier, and over changed fields."""
    a, b = (sources.read(spark, f"{sf_dir}/{t}.parquet", "parquet").schema for t in ("customer", "supplier"))
    c, d = _fields(id="int64!", name="string", age="int32"), _fields(id="int64", name="string!", age="int64")
    return _result_rows(spark, [(f"{level.value} {case}", Validator(level=level).validate_against(x, y)) for level in ValidationLevel for case, x, y in (("tables", a, b), ("fields", c, d), ("same", a, a))])


def _word_sql(stream: str, place: int) -> str:
    return f"(('0x' || substr({stream}, {1 + 8 * place}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _draw_sql(salt: str) -> str:
    i = generate.DRAWS.index(salt)
    return _word_sql(f"d{i // 4}", i % 4)


def _pick_sql(values: tuple[str, ...], salt: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][floor({_draw_sql(salt)} * {len(values)})::INTEGER + 1]"


G = generate.PairConfig(changed=0.25)


def _generated_sql(is_target: bool) -> str:
    """A generated side again: the same stream of draws, the fields by hand."""
    n_rows = "(SELECT count(*) FROM orders)"
    control = {c: _word_sql("c", i) for i, c in enumerate(generate.CONTROLS)}
    first, last = _pick_sql(generate.FIRST, "first"), _pick_sql(generate.LAST, "last")
    start = f"(1700000000 - floor({_draw_sql('created')} * 1000)::BIGINT * 86400)"
    update = f"({start} + floor({_draw_sql('updated')} * 300)::BIGINT * 86400)"
    at = lambda seconds: f"epoch_ms(({seconds}) * 1000)"
    mail = f"lower({first}) || '.' || lower({last}) || '@' || {_pick_sql(generate.DOMAINS, 'domain')}"
    fields = {
        "first_name": f"{first} || CASE WHEN error = 0 THEN 'X' ELSE '' END",
        "last_name": last,
        "email": f"CASE WHEN changed THEN 'modified_' || id || '@example.com' ELSE {mail} END",
        "age": f"(18 + floor({_draw_sql('age')} * 80) + CASE WHEN error = 1 THEN floor({_draw_sql('years')} * 5) ELSE 0 END)::INTEGER",
        "score": f"floor({_draw_sql('score')} * 100 * CASE WHEN error = 2 THEN 1.1::DOUBLE ELSE 1 END * 100) / 100",
        "balance": f"floor({_draw_sql('balance')} * 1000000) / 100 * CASE WHEN error = 3 THEN -1 ELSE 1 END",
        "active": f"{_draw_sql('active')} > 0.3::DOUBLE",
        "status": _pick_sql(generate.STATUS, "status"),
        "created_at": at(start),
        "updated_at": at(update),
        "state": _pick_sql(generate.STATES, "state"),
        "lat": f"{_draw_sql('lat')} * 170 - 85",
        "long": f"{_draw_sql('long')} * 360 - 180",
        "last_login": at(f"{update} + (1 + floor({_draw_sql('login')} * 30)::BIGINT) * 86400"),
    }
    if not is_target:
        for k in ("state", "lat", "long", "last_login"):
            del fields[k]
    own = ", ".join(f"CASE WHEN {_draw_sql('null ' + k)} >= {G.nulls}::DOUBLE THEN {v} END AS {k}" for k, v in fields.items())
    streams = ", ".join(f"md5(seed || ':' || n || ':{k}') AS d{k}" for k in range(-(-len(generate.DRAWS) // 4)))
    if is_target:
        numbers = f"SELECT CASE WHEN {control['reuse']} >= {G.new_ids}::DOUBLE THEN n ELSE n + size END AS n, size FROM (SELECT n, size, md5('{G.seed}:' || n || ':c') AS c FROM (SELECT unnest(range({n_rows})) AS n, {n_rows} AS size))"
        seeds = f"SELECT *, CASE WHEN n >= size OR changed THEN {G.seed + 1} ELSE {G.seed} END AS seed FROM (SELECT *, n < size AND {control['changed']} < {G.changed}::DOUBLE AS changed, CASE WHEN {control['error']} < {G.errors}::DOUBLE THEN floor({control['which']} * 4) ELSE -1 END AS error FROM (SELECT *, md5('{G.seed}:' || n || ':c') AS c FROM ({numbers})))"
    else:
        seeds = f"SELECT unnest(range({n_rows})) AS n, FALSE AS changed, -1 AS error, {G.seed} AS seed"
    return f"SELECT id, {own} FROM (SELECT *, substr(sha256('{G.seed}:' || n), 1, 32) AS id, {streams} FROM ({seeds}))"


def _generated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    config = dataclasses.replace(G, rows=_table(spark, sf_dir, "orders").count())
    return generate.source(spark, config), generate.target(spark, config)


_texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ("created_at", "updated_at"))


@query(
    f"""SELECT 'source' AS side, * EXCLUDE (created_at, updated_at), {_texts}, NULL::VARCHAR AS state, NULL::DOUBLE AS lat, NULL::DOUBLE AS long, NULL::VARCHAR AS last_login FROM ({_generated_sql(False)})
  UNION ALL SELECT 'target', * EXCLUDE (created_at, updated_at, state, lat, long, last_login), {_texts}, state, lat, long, CAST(last_login AS VARCHAR) FROM ({_generated_sql(True)})"""
)
def generated_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a generated pair, as many a side as there are orders, with errors, nulls and new ids."""
    a, b = _generated(spark, sf_dir)
    both = a.withColumn("side", F.lit("source")).unionByName(b.withColumn("side", F.lit("target")), allowMissingColumns=True)
    return both.withColumns({"score": F.col("score").cast("double")} | {c: F.col(c).cast("string") for c in ("created_at", "updated_at", "last_login")})


_g_flags = {c: _off(f"s.{c}", f"t.{c}") if c == "balance" else f"s.{c} IS DISTINCT FROM t.{c}" for c in generate.FIELDS[:10]}


@query(
    f"""WITH s AS ({_generated_sql(False)}), t AS ({_generated_sql(True)}), totals AS (SELECT (SELECT count(*) FROM s) AS total_source, (SELECT count(*) FROM t) AS total_target,
      (SELECT count(*) FROM t ANTI JOIN s USING (id)) AS added, (SELECT count(*) FROM s ANTI JOIN t USING (id)) AS deleted, (SELECT count(*) FROM s JOIN t USING (id) WHERE {" OR ".join(_g_flags.values())}) AS modified),
    each AS ({" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS modifications FROM s JOIN t USING (id) WHERE {f}""" for c, f in _g_flags.items())})
    SELECT * FROM totals, each"""
)
def generated_pair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and modified columns of a generated pair with as many rows as there are orders, errors and nulls included."""
    found = diff(*_generated(spark, sf_dir), DiffOptions(("id",), tolerance=TOL, unique_keys=True)).summary_frame
    return found.select("total_source", "total_target", "added", "deleted", "modified", F.explode("columns").alias("column", "modifications"))


@query(_modified_sql(FLAGS, _pair(), COLS))
def diff_key_from_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No keys are given: the source's schema names its primary key."""
    a, b = (_sql(spark, sf_dir, "orders", q) for q in (O_SOURCE, O_TARGET))
    source = Dataset(a, SchemaInfo(schema_of(a).fields, {"primary_key": "o_orderkey"}))
    return diff(source, b, DiffOptions(tolerance=TOL, unique_keys=True)).modified


T_SOURCE = "SELECT o_orderkey, named_struct('m', map('a', o_orderstatus, 'b', o_orderpriority), 'n', o_custkey) AS v FROM orders"
T_TARGET = "SELECT o_orderkey, named_struct('m', map('b', o_orderpriority, 'a', if(o_orderkey % 7 = 0, '?', o_orderstatus)), 'n', o_custkey + if(o_orderkey % 5 = 0, 1, 0)) AS v FROM orders"


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus AS a, o_custkey AS n FROM orders), t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE o_orderstatus END AS a, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n FROM orders)
  SELECT o_orderkey, FALSE AS _modified_o_orderkey, TRUE AS _modified_v FROM s JOIN t USING (o_orderkey) WHERE s.a IS DISTINCT FROM t.a OR s.n <> t.n""")
def diff_map_inside_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, T_TARGET, T_SOURCE).modified.drop("v")


# commands and reports: what users see as text comes back as rows


def _run(command: str, *arguments: str) -> str:
    """What a command of the command line prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        args = cli.parser().parse_args([command, *arguments])
        (cli.run_diff if command == "diff" else cli.run_schema)(args)
    return out.getvalue()


def _written_pair(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    folder = _folder(spark)
    for name, text in (("source", O_SOURCE), ("target", O_TARGET)):
        _sql(spark, sf_dir, "orders", text).write.parquet(f"{folder}/{name}.parquet")
    return f"{folder}/source.parquet", f"{folder}/target.parquet"


@query(
    f"""{_pair()} SELECT 'added' AS _change_type, t.* FROM t ANTI JOIN s USING (o_orderkey) UNION ALL SELECT 'deleted', s.* FROM s ANTI JOIN t USING (o_orderkey)
  UNION ALL SELECT 'modified', s.* FROM s JOIN t USING (o_orderkey) WHERE {" OR ".join(FLAGS.values())}"""
)
def cli_diff_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written tables compared from the command line, the last row of a key by the order of files; its output read."""
    out = _folder(spark) + ".parquet"
    _run("diff", *_written_pair(spark, sf_dir), "--key", "o_orderkey", "--output", out)
    return spark.read.parquet(out).select("_change_type", *COLS)


@query(
    f"""{_pair()}, totals AS ({_summary_sql(FLAGS, "").strip()}), by_column AS (
      {" UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, count(*) AS n FROM s JOIN t USING (o_orderkey) WHERE {f}" for i, (c, f) in enumerate(FLAGS.items()))})
    SELECT unnest(list_concat(['', 'Diff Summary:', '  Source records: ' || total_source, '  Target records: ' || total_target, '  Added records:   ' || added, '  Deleted records: ' || deleted, '  Modified records: ' || modified, '', 'Modified columns:'],
      (SELECT list('  ' || name || ': ' || n || ' modifications' ORDER BY place) FROM by_column WHERE n > 0))) AS line, generate_subscripts(list_concat(range(9), (SELECT list(n) FROM by_column WHERE n > 0)), 1)::BIGINT AS place FROM totals"""
)
def cli_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that a comparison of keys without repeats prints, by checksums first."""
    text = _run("diff", *_written_pair(spark, sf_dir), "--key", "o_orderkey", "--unique-keys", "--checksums")
    return spark.createDataFrame([(i + 1, line) for i, line in enumerate(text.rstrip("\n").split("\n"))], "place long, line string")


@query(
    """WITH s AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0)
  SELECT 'deleted' AS _change_type, s.* FROM s ANTI JOIN t USING (s_suppkey) UNION ALL SELECT 'modified', s.* FROM s JOIN t USING (s_suppkey) WHERE s.s_name IS DISTINCT FROM t.s_name"""
)
def cli_json_to_stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small comparison's changes as the JSON array that the command line prints."""
    folder = _folder(spark)
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows.write.parquet(f"{folder}/a.parquet")
    rows.where("s_suppkey % 4 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))).write.parquet(f"{folder}/b.parquet")
    found = json.loads(_run("diff", f"{folder}/a.parquet", f"{folder}/b.parquet", "--key", "s_suppkey", "-f", "json_array"))
    names = ("_change_type", "s_suppkey", "s_name", "s_acctbal")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], "_change_type string, s_suppkey long, s_name string, s_acctbal double")


_arrow = "CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END"


@query(
    f"""WITH a AS (SELECT column_name AS field, {_arrow} AS type FROM (DESCRIBE customer)), b AS (SELECT column_name AS field, {_arrow} AS type FROM (DESCRIBE supplier))
  SELECT field, 'only_in_source' AS kind, type AS source, NULL AS target FROM a ANTI JOIN b USING (field) UNION ALL SELECT field, 'only_in_target', NULL, type FROM b ANTI JOIN a USING (field)
  UNION ALL SELECT field, 'type', a.type, b.type FROM a JOIN b USING (field) WHERE a.type <> b.type"""
)
def cli_schema_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the schemas of two tables differ, from the JSON that the command line prints."""
    found = json.loads(_run("schema", f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet", "--level", "relaxed", "-f", "json"))
    return spark.createDataFrame([tuple(d) for d in found["differences"]], "field string, kind string, source string, target string")


@query(
    f"""SELECT 0::BIGINT AS place, 'Schema:' AS line UNION ALL
  SELECT row_number() OVER (), '  ' || column_name || ': ' || {_arrow.replace("ELSE 'string'", "WHEN 'TIMESTAMP' THEN 'timestamp[us]' ELSE 'string'")} || ' NULL' FROM (DESCRIBE lineitem)"""
)
def schema_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed schema of lineitem."""
    text = schema_text(sources.read(spark, f"{sf_dir}/lineitem.parquet", "parquet").schema)
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "place long, line string")


_config_message = """'lineitem' AS "case", FALSE AS valid, 'error' AS kind, {} AS rule, {} AS message"""


@query(
    f"""SELECT 'lineitem' AS "case", FALSE AS valid, 'outcome' AS kind, '' AS rule, '' AS message
  UNION ALL SELECT {_config_message.format("'RequiredFieldsRule'", "'required fields missing: ' || string_agg(f, ', ' ORDER BY f)")} FROM (VALUES ('l_orderkey'), ('l_container'), ('l_weight')) AS w(f) WHERE f NOT IN (SELECT n FROM {_columns})
  UNION ALL SELECT {_config_message.format("'FieldTypeRule'", "'field type validation failed: field ''' || n || ''' has type ''double'', but expected one of: float, int64'")} FROM {_columns} WHERE n = 'l_tax' AND t = 'DOUBLE'
  UNION ALL SELECT {_config_message.format("'DictionaryEncodingRule'", "'string fields should use dictionary encoding: ' || string_agg(n, ', ')")} FROM {_columns} WHERE t = 'VARCHAR' AND n <> 'l_returnflag'"""
)
def schema_config_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a configuration file over the declared schema of lineitem."""
    config = {"validation_level": "strict", "required_fields": ["l_orderkey", "l_container", "l_weight"], "field_types": {"l_tax": ["float", "int64"]}, "string_fields_require_dictionary": True, "dictionary_exempt_fields": ["l_returnflag"]}
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "rules.json")
        with open(path, "w") as f:
            json.dump(config, f)
        validator = validator_from_file(path)
    return _result_rows(spark, [("lineitem", validator.validate(sources.read(spark, f"{sf_dir}/lineitem.parquet", "parquet").schema))])


@query("SELECT * FROM orders WHERE o_orderkey % 4 <> 2")
def source_concat_full_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a table on end: one kept once read, one as it is, one without rows."""
    whole = sources.read(spark, f"{sf_dir}/orders.parquet")
    kept = sources.full_load(dataclasses.replace(whole, df=whole.df.where("o_orderkey % 4 = 0")))
    return sources.concat(kept.df, whole.df.where("o_orderkey % 2 = 1"), sources.empty_like(whole.df))


@query(
    f"""SELECT replace(path_in_schema, ', ', '.') AS "column", any_value(type) AS type, count(*) AS row_groups, sum(num_values)::BIGINT AS n_values, sum(stats_null_count)::BIGINT AS nulls, sum(total_compressed_size)::BIGINT AS compressed, sum(total_uncompressed_size)::BIGINT AS uncompressed
    FROM parquet_metadata('{FIXED_DIR}/lineitem.parquet') GROUP BY path_in_schema"""
)
def source_column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the inspector adds up over all row groups of lineitem."""
    return column_statistics(spark, f"{sf_dir}/lineitem.parquet")


@query(f"{_pair()} SELECT 'added' AS _change_type, t.* FROM t ANTI JOIN s USING (o_orderkey) UNION ALL SELECT 'modified', s.* FROM s JOIN t USING (o_orderkey) WHERE {' OR '.join(FLAGS.values())}")
def diff_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target as a stream of files, each batch compared with the source's rows of its keys."""
    folder = _folder(spark)
    target = _sql(spark, sf_dir, "orders", O_TARGET)
    target.repartition(3, "o_orderkey").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(target.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def keep(result: DiffResult, number: int) -> None:
        result.changes().select("_change_type", *COLS).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = diff_stream(stream, _sql(spark, sf_dir, "orders", O_SOURCE), DiffOptions(("o_orderkey",), tolerance=TOL), keep, f"{folder}/checkpoint")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("""SELECT 'incompatible types for column o_custkey: ' || lower(column_type) || ' and string' AS refused FROM (DESCRIBE orders) WHERE column_name = 'o_custkey'""")
def diff_refuses_other_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of two types is told before anything runs; ignored, it is none."""
    source = _table(spark, sf_dir, "orders")
    target = source.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    said = []
    for ignore in ((), ("o_custkey",)):
        try:
            diff(source, target, DiffOptions(("o_orderkey",), ignore=ignore, unique_keys=True))
        except TypeError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "refused string")



def lineitem_pair(spark: SparkSession, sf_dir: str, target_dir: str | None = None) -> DiffResult:
    """The benchmark workload: all columns of lineitem, two keys that are not unique, tolerance 1e-4."""
    source = _table(spark, sf_dir, "lineitem")
    target = source.where("l_partkey % 11 <> 0").withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0))
    return diff(source.where("l_partkey % 17 <> 0"), target, DiffOptions(L_KEYS, tolerance=TOL))
