"""Type names of configuration files, and the way between Arrow and Spark types."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowdelta.model import FieldInfo, SchemaInfo

#: The names that configuration files may use.
NAMES: dict[str, pa.DataType] = {
    "bool": pa.bool_(),
    "boolean": pa.bool_(),
    "int8": pa.int8(),
    "uint8": pa.uint8(),
    "int16": pa.int16(),
    "uint16": pa.uint16(),
    "int32": pa.int32(),
    "int": pa.int32(),
    "uint32": pa.uint32(),
    "uint": pa.uint32(),
    "int64": pa.int64(),
    "long": pa.int64(),
    "uint64": pa.uint64(),
    "ulong": pa.uint64(),
    "float": pa.float32(),
    "float32": pa.float32(),
    "double": pa.float64(),
    "float64": pa.float64(),
    "string": pa.string(),
    "utf8": pa.string(),
    "binary": pa.binary(),
    "date": pa.date32(),
    "timestamp": pa.timestamp("s"),
    "timestamp[ms]": pa.timestamp("ms"),
    "timestamp[us]": pa.timestamp("us"),
    "timestamp[ns]": pa.timestamp("ns"),
}


def parse_type(name: str) -> pa.DataType:
    """The Arrow type of a name, in any case; decimals are ``decimal(precision,scale)``."""
    if found := NAMES.get(name.lower()):
        return found
    if m := re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(-?\d+)\s*\)", name):
        return pa.decimal128(int(m[1]), int(m[2]))
    raise ValueError(f"unsupported Arrow type: {name}")


def same_type(a: pa.DataType, b: pa.DataType) -> bool:
    return a.equals(b)


def spark_type(kind: pa.DataType) -> T.DataType:
    """The Spark type that holds all values of an Arrow type; unsigned integers widen."""
    wider = {pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0), pa.float16(): T.FloatType()}
    if kind in wider:
        return wider[kind]
    if pa.types.is_timestamp(kind):
        return T.TimestampType() if kind.tz else T.TimestampNTZType()
    if pa.types.is_dictionary(kind):
        return spark_type(kind.value_type)
    if pa.types.is_decimal(kind) and kind.precision <= 38:
        return T.DecimalType(kind.precision, kind.scale)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return T.ArrayType(spark_type(kind.value_type))
    if pa.types.is_struct(kind):
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in kind])
    if pa.types.is_map(kind):
        return T.MapType(spark_type(kind.key_type), spark_type(kind.item_type))
    simple = {
        pa.bool_(): T.BooleanType(), pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(),
        pa.string(): T.StringType(), pa.large_string(): T.StringType(), pa.binary(): T.BinaryType(), pa.large_binary(): T.BinaryType(), pa.date32(): T.DateType(), pa.date64(): T.DateType(),
    }
    if kind in simple:
        return simple[kind]
    raise TypeError(f"unsupported type: {kind}")


def schema_of(df: DataFrame) -> SchemaInfo:
    """A descriptor from Spark's own schema, where no file says more."""
    return SchemaInfo(tuple(FieldInfo(f.name, to_arrow_type(f.dataType), f.nullable) for f in df.schema.fields))
