"""Rules of a schema held against the rows of a table, all in one aggregate pass.

A rule that :class:`Validator` holds against what a file declares says here how many values break it, and the first key
at which. A declared type that a rule allows needs no look at the values; another one is judged value by value: whether
each could be read as an allowed type without loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import DecimalPrecisionRule, FieldTypeRule, NullabilityRule, RequiredFieldsRule, Rule, TemporalFormatRule
from .types import spark_type

#: A text with a zone that is UTC.
UTC_TEXT = r"(Z|[+-]00:?00)$"


@dataclass(frozen=True)
class Check:
    rule: str
    field: str
    #: true where a value breaks the rule; null is no break
    broken: Column


def _loses(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """Whether a value that is not null would be lost or changed as ``want``."""
    read = value.try_cast(want)
    if isinstance(have, T.StringType) or isinstance(want, T.StringType):
        if isinstance(have, T.StringType) and isinstance(want, T.DecimalType):
            # digits beyond the scale would be rounded away
            return read.isNull() | (value.try_cast(T.DecimalType(38, min(18, want.scale + 6))) != read)
        if isinstance(have, T.StringType) and isinstance(want, T.IntegralType):
            return read.isNull() | ~F.trim(value).rlike(r"^[+-]?[0-9]+$")
        return read.isNull()
    if isinstance(have, T.NumericType) and isinstance(want, T.NumericType):
        return read.isNull() | ~read.try_cast(have).eqNullSafe(value)
    if isinstance(have, T.TimestampType | T.TimestampNTZType) and isinstance(want, T.DateType):
        return read.cast(have) != value
    return read.isNull()


def _castable(have: T.DataType, want: T.DataType) -> bool:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    if isinstance(have, nested) or isinstance(want, nested):
        return False
    if isinstance(have, T.StringType) or isinstance(want, T.StringType):
        return True
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(have, times) or isinstance(want, times):
        return isinstance(have, times) and isinstance(want, times)
    return True


def checks_of(rules: Sequence[Rule], schema: T.StructType) -> Iterator[Check]:
    """What the rules ask of each column that is present; rules about metadata, encodings and types of each other ask
    nothing of rows."""
    have = {f.name: f.dataType for f in reversed(schema.fields)}
    col = lambda n: F.col(f"`{n.replace('`', '``')}`")
    for rule in rules:
        if isinstance(rule, RequiredFieldsRule):
            for n in rule.fields:
                if n in have:
                    blank = F.trim(col(n)) == "" if isinstance(have[n], T.StringType) else F.lit(False)
                    yield Check(rule.name, n, col(n).isNull() | blank)
        elif isinstance(rule, NullabilityRule):
            for n in rule.fields:
                if n in have:
                    yield Check(rule.name, n, col(n).isNull())
        elif isinstance(rule, FieldTypeRule):
            for n, kinds in rule.allowed.items():
                if n in have:
                    wanted = [spark_type(k) for k in kinds]
                    lost = F.lit(True)
                    for want in wanted:
                        if want == have[n]:
                            lost = F.lit(False)
                            break
                        if _castable(have[n], want):
                            lost = lost & _loses(col(n), have[n], want)
                    yield Check(rule.name, n, col(n).isNotNull() & lost)
        elif isinstance(rule, DecimalPrecisionRule):
            for n, (precision, scale) in rule.required.items():
                if n in have and _castable(have[n], T.DecimalType(precision, scale)):
                    yield Check(rule.name, n, col(n).isNotNull() & _loses(col(n), have[n], T.DecimalType(precision, scale)))
        elif isinstance(rule, TemporalFormatRule):
            for n in rule.dates:
                if n in have and _castable(have[n], T.DateType()):
                    yield Check(rule.name, n, col(n).isNotNull() & _loses(col(n), have[n], T.DateType()))
            for n in rule.timestamps:
                if n in have and _castable(have[n], T.TimestampType()):
                    late = _loses(col(n), have[n], T.TimestampType())
                    if rule.timezone == "UTC" and isinstance(have[n], T.StringType):
                        late = late | ~F.trim(col(n)).rlike(UTC_TEXT)
                    yield Check(rule.name, n, col(n).isNotNull() & late)


def check_data(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """(rule, field, rows, violations, first_key) of each rule and column that it asks something of, from one pass.

    first_key is the JSON of the least ``keys`` whose row breaks the rule, null if none does or no keys are given. Only
    the columns that are asked about are read. No rows break nothing."""
    checks = list(checks_of(rules, df.schema))
    out = "rule string, field string, rows bigint, violations bigint, first_key string"
    if not checks:
        return df.sparkSession.createDataFrame([], out)
    key = F.struct(*[F.col(f"`{k.replace('`', '``')}`").alias(k) for k in keys]) if keys else None
    totals = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(checks):
        totals.append(F.count_if(c.broken).alias(f"n{i}"))
        if key is not None:
            totals.append(F.min(F.when(c.broken, key)).alias(f"k{i}"))
    one = df.agg(*totals)
    first = lambda i: F.to_json(F.col(f"k{i}"), {"ignoreNullFields": "false"}) if key is not None else F.lit(None).cast("string")
    rows = [F.struct(F.lit(c.rule).alias("rule"), F.lit(c.field).alias("field"), F.col("rows"), F.col(f"n{i}").alias("violations"), first(i).alias("first_key")) for i, c in enumerate(checks)]
    return one.select(F.inline(F.array(*rows)))
