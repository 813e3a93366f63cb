"""Lineage, masking, erasure and the diagnosis of double hashing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..functions.masking import mask

PREFIX = "_dc_"


@dataclass(frozen=True)
class RunInfo:
    run_id: str
    contract: str = ""
    version: str | None = None
    source: str = ""
    domain: str | None = None
    system: str | None = None
    created_by: str = "millrace"
    at: datetime | None = None


def lineage(df: DataFrame, run: RunInfo, flags: dict[str, bool] | None = None, upstream_prefix: str | None = None) -> DataFrame:
    """Constant columns that say where rows come from; upstream ones are kept under a prefix."""
    at = (run.at or datetime.now(timezone.utc)).replace(microsecond=0).isoformat()
    values = {
        "source": run.source, "processed_at": at, "run_id": run.run_id,
        "contract_name": run.contract + (f" (v{run.version})" if run.version else ""),
        "domain": run.domain, "system": run.system, "created_at": at, "created_by": run.created_by,
    }
    if upstream_prefix:
        df = df.withColumnsRenamed({c: upstream_prefix + c.removeprefix(PREFIX) for c in df.columns if c in {PREFIX + k for k in values}})
    return df.withColumns({PREFIX + k: F.lit(v).cast("string") for k, v in values.items() if (flags or {}).get(k, True)})


@dataclass(frozen=True)
class Masked:
    field: str
    strategy: str
    format: str | None = None


def apply_masks(df: DataFrame, masks: list[Masked], salt: str = "", key: str | None = None, user_groups: set[str] = frozenset(), allowed_groups: set[str] = frozenset()) -> DataFrame:
    """Mask the fields, unless the user is in a group that may see them."""
    if user_groups & allowed_groups:
        return df
    return df.withColumns({m.field: mask(col(m.field), df.schema[m.field].dataType, m.strategy, salt, key, m.format) for m in masks if m.field in df.columns})


def vault(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The clear values that masking hides, with their key, for a store of their own."""
    return df.select(*[col(c) for c in [*keys, *fields]]).distinct()


def policy_report(df: DataFrame, masks: list[Masked]) -> list[dict]:
    have = {m.field: m for m in masks}
    return [{"field": f.name, "type": f.dataType.simpleString(), "strategy": have[f.name].strategy} for f in df.schema if f.name in have]


def erase(
    df: DataFrame, subject: str, ids: list, masks: list[Masked], reason: str = "erasure_request", where: Column | None = None, at: Column | None = None, salt: str = ""
) -> DataFrame:
    """Rows of the given subjects with their sensitive fields masked and stamped; the subject column stays as it is or is hashed, never null."""
    hit = F.coalesce(col(subject).isin(ids), F.lit(False))
    if where is not None:
        hit = hit & where
    now = at if at is not None else F.current_timestamp()
    changed = {}
    for m in masks:
        if m.field not in df.columns or (m.field == subject and m.strategy == "nullify"):
            continue
        changed[m.field] = F.when(hit, mask(col(m.field), df.schema[m.field].dataType, m.strategy, salt, None, m.format)).otherwise(col(m.field))
    stamps = {"_dc_is_deleted": (F.lit(True), "boolean"), "_dc_deleted_at": (now, "timestamp"), "_dc_delete_reason": (F.lit(reason), "string"), "_dc_updated_at": (now, "timestamp")}
    for name, (value, kind) in stamps.items():
        old = col(name) if name in df.columns else F.lit(False if kind == "boolean" else None).cast(kind)
        changed[name] = F.when(hit, value).otherwise(old)
    return df.withColumns(changed)


def double_hash(clear: DataFrame, stored: DataFrame, key: str, field: str, salt: str = "") -> DataFrame:
    """(verdict, rows): is a stored hash the hash of the clear value, or the hash of its hash?"""
    once = F.sha2(F.concat(F.lit(salt), col("__c")), 256)
    twice = F.sha2(F.concat(F.lit(salt), once), 256)
    a = clear.groupBy(col(key).alias("__k")).agg(F.count("*").alias("__n"), F.first(col(field).cast("string")).alias("__c"))
    b = stored.groupBy(col(key).alias("__k2")).agg(F.count("*").alias("__m"), F.first(col(field).cast("string")).alias("__s"))
    joined = a.join(b, F.col("__k") == F.col("__k2"), "full")
    verdict = (
        F.when(F.col("__k").isNull() | F.col("__k2").isNull(), "unjoined")
        .when((F.col("__n") > 1) | (F.col("__m") > 1), "ambiguous_key")
        .when(F.col("__c").isNull() | F.col("__s").isNull(), "null")
        .when(F.col("__s") == once, "consistent")
        .when(F.col("__s") == twice, "double_hashed")
        .otherwise("indeterminate")
    )
    return joined.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows"))


def reconcile_counts(source: int, good: int, quarantined: int) -> dict[str, int]:
    """total = good + quarantined; what the source had more was dropped, what it had less was added."""
    total = good + quarantined
    return {"source": source, "good": good, "quarantined": quarantined, "total": total, "pre_transform_dropped": max(0, source - total), "added": max(0, total - source)}
