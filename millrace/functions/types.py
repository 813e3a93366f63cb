"""The one map from contract type names to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN: dict[str, T.DataType] = {}
for _names, _kind in (
    ("string text char varchar json", T.StringType()),
    ("tinyint byte", T.ByteType()),
    ("smallint short", T.ShortType()),
    ("int integer int32", T.IntegerType()),
    ("bigint long int64", T.LongType()),
    ("float float32 real", T.FloatType()),
    # a decimal without parameters is a double: exact decimals name their width
    ("double float64 number decimal numeric", T.DoubleType()),
    ("boolean bool", T.BooleanType()),
    ("date", T.DateType()),
    ("timestamp datetime timestamp_tz", T.TimestampType()),
    ("timestamp_ntz", T.TimestampNTZType()),
    ("binary", T.BinaryType()),
    ("array", T.ArrayType(T.StringType())),
):
    for _name in _names.split():
        _PLAIN[_name] = _kind


def spark_type(name: str | None) -> T.DataType | None:
    """Spark's type for a contract type; None for names that are not known."""
    if not name:
        return None
    text = name.strip().lower()
    if text in _PLAIN:
        return _PLAIN[text]
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if re.fullmatch(r"(?:varchar|char|string)\s*\(\s*\d+\s*\)", text):
        return T.StringType()
    if text.startswith(("struct<", "array<", "map<")):
        return T.DataType.fromDDL(name)
    return None


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType | T.ArrayType | T.MapType)


#: widenings that a stored column may get in place
WIDENS: dict[str, tuple[str, ...]] = {
    "tinyint": ("smallint", "int", "bigint"),
    "smallint": ("int", "bigint"),
    "int": ("bigint",),
    "float": ("double",),
    "date": ("timestamp",),
}


def can_widen(old: T.DataType, new: T.DataType) -> bool:
    """May a column of type ``old`` become ``new`` without a value changing?"""
    if old == new:
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return new.simpleString() in WIDENS.get(old.simpleString(), ())
