"""Upserts, change data and reconciliation as frame functions: (existing, incoming) -> new state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import all_of, any_of, col, small_enough, surrogate_key

DELETED, DELETED_AT, REASON, SURROGATE = "_dc_is_deleted", "_dc_deleted_at", "_dc_delete_reason", "_sk"


@dataclass(frozen=True)
class SoftDelete:
    flag: str = DELETED
    value: object = True
    at: str | None = DELETED_AT
    reason: str | None = REASON
    timestamp_field: str | None = None


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; ties by all other columns.  Null keys never match and all stay."""
    blank = any_of(col(k).isNull() for k in keys)
    by = [col(c).desc_nulls_last() for c in order] + [col(f.name).desc_nulls_last() for f in df.schema if f.name not in order and not isinstance(f.dataType, T.MapType)]
    place = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*by))
    kept = df.filter(~blank).withColumn("__n", place).filter("__n = 1").drop("__n")
    return kept.unionByName(df.filter(blank))


def _same(keys: list[str], a: str, b: str) -> Column:
    return all_of(F.col(f"{a}.`{k}`") == F.col(f"{b}.`{k}`") for k in keys)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Matched rows take all incoming columns, others stay or are added; columns are united by name.

    ``keep_first``: columns whose existing value outlives a merge (creation stamps).
    """
    if keep_first:
        held = [c for c in keep_first if c in existing.columns and c in incoming.columns]
        before = existing.select(*[col(k).alias(f"__k_{k}") for k in keys], *[col(c).alias(f"__h_{c}") for c in held])
        joined = incoming.join(before, all_of(col(k) == col(f"__k_{k}") for k in keys), "left")
        incoming = joined.select(*[F.coalesce(col(f"__h_{c}"), col(c)).alias(c) if c in held else col(c) for c in incoming.columns])
    kept = existing.alias("e").join(incoming.select(*[col(k) for k in keys]).alias("i"), _same(keys, "e", "i"), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def apply_changes(
    existing: DataFrame, changes: DataFrame, keys: list[str], op_field: str, delete_values: list[str], soft: SoftDelete | None = None, order: list[str] | None = None, now: Column | None = None
) -> DataFrame:
    """Change data: deletes by ``op_field``, the rest an upsert.

    Hard: the row goes and the delete marker is not written.  Soft: the existing row keeps its
    data and gets flag, time and reason; a delete of an unseen key is kept as a tombstone.
    """
    if order:
        changes = last_per_key(changes, keys, order)
    gone = F.coalesce(col(op_field).isin(delete_values), F.lit(False))
    upserts, deletes = changes.filter(~gone).drop(op_field), changes.filter(gone)
    if soft is None:
        left = existing.alias("e").join(deletes.select(*keys).alias("d"), _same(keys, "e", "d"), "left_anti")
        return upsert(left, upserts, keys)
    at = F.coalesce(col(soft.timestamp_field).cast("timestamp") if soft.timestamp_field else F.lit(None).cast("timestamp"), now if now is not None else F.current_timestamp())
    stamps = {soft.flag: F.lit(soft.value)}
    if soft.at:
        stamps[soft.at] = at
    if soft.reason:
        stamps[soft.reason] = F.lit("cdc_delete_signal")
    tombs = deletes.drop(op_field).withColumns(stamps)
    clean = {soft.flag: F.lit(not soft.value if isinstance(soft.value, bool) else None).cast(T.BooleanType() if isinstance(soft.value, bool) else T.StringType())}
    if soft.at:
        clean[soft.at] = F.lit(None).cast("timestamp")
    if soft.reason:
        clean[soft.reason] = F.lit(None).cast("string")
    base = existing.withColumns({c: v for c, v in clean.items() if c not in existing.columns})
    names = list(stamps)
    marks = tombs.select(*[col(k).alias(f"__k_{k}") for k in keys], *[col(c).alias(f"__d_{c}") for c in names])
    hit = base.join(marks, all_of(col(k) == col(f"__k_{k}") for k in keys), "left")
    marked = hit.select(*[F.when(col(f"__k_{keys[0]}").isNotNull(), col(f"__d_{c}")).otherwise(col(c)).alias(c) if c in names else col(c) for c in base.columns])
    unseen = tombs.alias("d").join(existing.alias("e"), _same(keys, "d", "e"), "left_anti")
    state = marked.unionByName(unseen, allowMissingColumns=True)
    return upsert(state, upserts.withColumns(clean), keys)


def with_surrogate_key(df: DataFrame, keys: list[str], name: str = SURROGATE) -> DataFrame:
    """A stable key in the first column; rows of the unknown member keep theirs."""
    made = surrogate_key(keys)
    if name in df.columns:
        made = F.coalesce(col(name), made)
    return df.select(made.alias(name), *[col(c) for c in df.columns if c != name])


def unknown_member(df: DataFrame, keys: list[str], sk: str = SURROGATE, lengths: dict[str, int] | None = None) -> DataFrame:
    """``df`` with its row for facts without a dimension, added once."""
    lengths = lengths or {}

    def value(f: T.StructField) -> Column:
        if f.name == sk:
            return F.lit("-1").cast(f.dataType)
        if f.name in ("is_current",):
            return F.lit(True)
        if f.name == "_version":
            return F.lit(0).cast(f.dataType)
        if f.name == "_change_reason":
            return F.lit("unknown_member")
        if f.name == "effective_from":
            return F.lit("1900-01-01").cast(f.dataType)
        if f.name == "effective_to":
            return F.lit("9999-12-31").cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            return F.lit("Unknown"[: lengths.get(f.name, 7)])
        if isinstance(f.dataType, T.BooleanType):
            return F.lit(False)
        if isinstance(f.dataType, T.NumericType):
            return F.lit(-1).cast(f.dataType)
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            return F.lit("1900-01-01").cast(f.dataType)
        return F.lit(None).cast(f.dataType)

    one = df.sparkSession.range(1).select(*[value(f).alias(f.name) for f in df.schema])
    return df.filter(~F.coalesce(col(sk) == "-1", F.lit(False))).unionByName(one)


class TooManyDeletes(RuntimeError):
    """A snapshot would delete more of the target than is allowed."""


def reconcile(
    existing: DataFrame, snapshot: DataFrame, keys: list[str], soft: SoftDelete | None = None, scope: Column | None = None, max_delete_ratio: float | None = None, now: Column | None = None
) -> DataFrame:
    """The new state after a load that is the complete set (within ``scope``).

    Keys that the load lacks are deleted (soft where a flag is given), keys that come
    back are restored.  One count guards against a partial load.
    """
    live = existing
    if soft and soft.flag in existing.columns:
        live = live.filter(~F.coalesce(col(soft.flag) == F.lit(soft.value), F.lit(False)))
    if SURROGATE in existing.columns:
        live = live.filter(~F.coalesce(col(SURROGATE) == "-1", F.lit(False)))
    if scope is not None:
        live = live.filter(scope)
    missing = live.alias("e").join(snapshot.select(*keys).alias("s"), _same(keys, "e", "s"), "left_anti").select(*keys)
    if max_delete_ratio is not None:
        n, gone = live.count(), missing.count()
        if n and gone / n > max_delete_ratio:
            raise TooManyDeletes(f"{gone} of {n} rows are missing from the snapshot; at most {max_delete_ratio:.0%} may be")
    op = "__op"
    changes = snapshot.withColumn(op, F.lit("u")).unionByName(missing.withColumn(op, F.lit("d")), allowMissingColumns=True)
    out = apply_changes(existing, changes, keys, op, ["d"], soft, now=now)
    if soft and soft.reason:
        out = out.withColumn(soft.reason, F.when(col(soft.reason) == "cdc_delete_signal", "missing_from_snapshot").otherwise(col(soft.reason)))
    return out


def merge_partitions(existing: DataFrame, incoming: DataFrame, partition_by: list[str], merge) -> tuple[DataFrame, DataFrame]:
    """(new rows of the partitions that the batch touches, those partitions).

    ``merge(existing, incoming)`` sees only these partitions; they are what a dynamic
    partition overwrite writes.
    """
    touched = incoming.select(*partition_by).distinct()
    same = [F.col(f"e.`{p}`").eqNullSafe(F.col(f"t.`{p}`")) for p in partition_by]
    inside = existing.alias("e").join(F.broadcast(touched.alias("t")) if _few(touched) else touched.alias("t"), same, "left_semi")
    return merge(inside, incoming), touched


def _few(df: DataFrame, rows: int = 10_000, size: int = 8 << 20) -> bool:
    return small_enough(df, rows, size)
