"""Schema enforcement and flattening of nested columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, text_of
from ..functions.types import is_nested, spark_type
from .rules import READ_ERROR, type_mismatch


@dataclass(frozen=True)
class Field:
    name: str
    type: str | None = None
    required: bool = False
    min: Any = None
    max: Any = None
    max_length: int | None = None
    accepted_values: tuple[Any, ...] = ()
    pii: bool = False
    masking: str | None = None
    masking_format: str | None = None
    generated: bool = False
    extra: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Policy:
    evolution: str = "compatible"
    #: quarantine, drop or allow
    unknown_fields: str = "allow"
    #: a frame all in text, whatever the types say
    cast_to_string: bool = False


def enforce(df: DataFrame, fields: list[Field], policy: Policy = Policy()) -> tuple[DataFrame, list[tuple[Column, str]]]:
    """(frame in declared order and types, error conditions over helper columns).

    Missing columns are null of their type; values that can't be cast are null and
    an error of their row.  Nested values become JSON text where text is declared.
    """
    if not fields:
        return df, []
    have = {c.lower(): c for c in df.columns}
    errors: list[tuple[Column, str]] = []
    out: list[Column] = []
    for f in fields:
        kind = T.StringType() if policy.cast_to_string else spark_type(f.type)
        name = have.get(f.name.lower())
        if name is None:
            out.append(F.lit(None).cast(kind or T.StringType()).alias(f.name))
            continue
        now = df.schema[name].dataType
        if kind is None or now == kind:
            out.append(col(name).alias(f.name))
        elif isinstance(kind, T.StringType):
            out.append(text_of(df, name).alias(f.name))
        elif is_nested(kind) and isinstance(now, T.StringType):
            parsed = F.from_json(col(name), kind)
            out.append(parsed.alias(f.name))
            out.append((col(name).isNotNull() & parsed.isNull()).alias(f"__bad_{f.name}"))
            errors.append((col(f"__bad_{f.name}"), f"Type Mismatch: {f.name} cannot be cast to {f.type}"))
        elif is_nested(now) and not is_nested(kind):
            out.append(text_of(df, name).try_cast(kind).alias(f.name))
        elif is_nested(kind):
            out.append(col(name).cast(kind).alias(f.name))
        else:
            message, bad = type_mismatch(name, f.type)
            out.append(col(name).try_cast(kind).alias(f.name))
            out.append(bad.alias(f"__bad_{f.name}"))
            errors.append((col(f"__bad_{f.name}"), message))
    known = {f.name.lower() for f in fields}
    unknown = [c for c in df.columns if c.lower() not in known and c != READ_ERROR and not c.startswith("_dc_")]
    missing = [f.name for f in fields if f.name.lower() not in have and not f.generated]
    if policy.unknown_fields != "drop":
        out += [col(c) for c in unknown]
    out += [col(c) for c in df.columns if c == READ_ERROR or c.startswith("_dc_")]
    if policy.evolution == "strict" and missing:
        errors.append((F.lit(True), f"Missing fields: {', '.join(missing)}"))
    if policy.unknown_fields == "quarantine" and unknown:
        errors.append((F.lit(True), f"Unknown fields: {', '.join(sorted(unknown))}"))
    return df.select(*out), errors


def struct_drift(df: DataFrame, fields: list[Field]) -> list[str]:
    """Declared struct members that a column lacks."""
    out = []
    for f in fields:
        kind = spark_type(f.type)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or f.name not in df.columns:
            continue
        now = df.schema[f.name].dataType
        while isinstance(now, T.ArrayType):
            now = now.elementType
        if isinstance(now, T.StructType):
            lost = sorted(set(kind.fieldNames()) - set(now.fieldNames()))
            if lost:
                out.append(f"{f.name}: missing members {', '.join(lost)}")
    return out


def flatten(df: DataFrame, max_depth: int = 5, sep: str = "_") -> DataFrame:
    """Struct members as ``parent_child`` columns, from the schema; arrays and maps as JSON text."""
    for _ in range(max_depth):
        if not any(isinstance(f.dataType, T.StructType) for f in df.schema):
            break
        taken = {f.name for f in df.schema if not isinstance(f.dataType, T.StructType)}
        out = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                for m in f.dataType:
                    name = f"{f.name}{sep}{m.name}"
                    while name in taken:
                        name += sep
                    taken.add(name)
                    out.append(col(f.name).getField(m.name).alias(name))
            else:
                out.append(col(f.name))
        df = df.select(*out)
    return df.select(*[(F.to_json(col(f.name)) if is_nested(f.dataType) else col(f.name)).alias(f.name) for f in df.schema])


def flatten_json(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A JSON text column with a declared struct type, flattened."""
    return flatten(df.withColumn(name, F.from_json(col(name), kind)))


def cast_all_text(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Types for a frame that is all text; other frames stay."""
    if any(not isinstance(f.dataType, T.StringType) for f in df.schema):
        return df
    return df.withColumns({f.name: col(f.name).try_cast(spark_type(f.type)) for f in fields if f.name in df.columns and spark_type(f.type) is not None})
