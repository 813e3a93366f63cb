"""Many datasets at once: freshness and volume by layer, schema drift, scope of rule checks, cost."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col
from ..functions.types import can_widen
from .rules import Rule, check_in_place


def fleet_freshness(runs: DataFrame, thresholds_hours: dict[str, float], now: Column, default_hours: float = 24.0) -> DataFrame:
    """(dataset, last_success, age_hours, passed) of every dataset in a run log."""
    last = runs.filter("status = 'success'").groupBy("dataset").agg(F.max(F.col("timestamp").cast("timestamp")).alias("last_success"))
    limit: Column = F.lit(default_hours)
    for name, hours in thresholds_hours.items():
        limit = F.when(F.col("dataset") == name, F.lit(hours)).otherwise(limit)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("last_success")) / F.lit(3.6e9)
    return last.withColumn("age_hours", age).withColumn("passed", F.col("age_hours") <= limit)


def fleet_volume(runs: DataFrame) -> DataFrame:
    """(dataset, runs, rows, median_rows, failed) of every dataset."""
    ok = F.when(F.col("status") == "success", F.col("counts_good"))
    return runs.groupBy("dataset").agg(
        F.count("*").alias("runs"), F.coalesce(F.sum(ok), F.lit(0)).cast("long").alias("rows"), F.median(ok).cast("double").alias("median_rows"), F.count_if(F.col("status") == "failed").alias("failed")
    )


@dataclass(frozen=True)
class Drift:
    column: str
    kind: str
    detail: str


def schema_drift(before: T.StructType, now: T.StructType) -> list[Drift]:
    """What changed between two schemas: added, removed, widened or retyped columns, and nullability."""
    old, new = {f.name: f for f in before}, {f.name: f for f in now}
    out = [Drift(n, "removed", old[n].dataType.simpleString()) for n in old if n not in new]
    for n, f in new.items():
        if n not in old:
            out.append(Drift(n, "added", f.dataType.simpleString()))
        elif old[n].dataType != f.dataType:
            kind = "widened" if can_widen(old[n].dataType, f.dataType) else "retyped"
            out.append(Drift(n, kind, f"{old[n].dataType.simpleString()} -> {f.dataType.simpleString()}"))
        elif old[n].nullable != f.nullable:
            out.append(Drift(n, "nullability", str(f.nullable)))
    return out


@dataclass(frozen=True)
class CheckScope:
    """Which rows a rule check has to look at: all, those after a mark, or none."""

    kind: str
    field: str | None = None
    after: Any = None


def plan_check(rules: list[Rule], last: dict[str, Any] | None, newest: Any, field: str | None) -> CheckScope:
    """Everything if rules changed or nothing is known; else only rows after the last check's mark; nothing if there are none."""
    signature = sorted(r.message() for r in rules)
    if last is None or last.get("rules") != signature or field is None or last.get("newest") is None:
        return CheckScope("full")
    if newest is not None and newest <= last["newest"]:
        return CheckScope("skip")
    return CheckScope("changed", field, last["newest"])


def run_check(df: DataFrame, rules: list[Rule], last: dict[str, Any] | None = None, field: str | None = None) -> tuple[DataFrame | None, dict[str, Any]]:
    """(results, what to remember for the next check)."""
    newest = df.agg(F.max(col(field))).first()[0] if field else None
    scope = plan_check(rules, last, newest, field)
    memo = {"rules": sorted(r.message() for r in rules), "newest": newest, "scope": scope.kind}
    if scope.kind == "skip":
        return None, memo
    rows = df.filter(col(scope.field) > F.lit(scope.after)) if scope.kind == "changed" else df
    return check_in_place(rows, rules), memo


def rule_results(results: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Results of a check as rows of a history: status, rows evaluated and failed."""
    status = F.when(F.col("failed_rows") == 0, "passed").otherwise("failed")
    return results.select(F.lit(run_id).alias("run_id"), F.lit(at).cast("timestamp").alias("checked_at"), "rule", status.alias("status"), "rows_evaluated", "failed_rows")


def cost(seconds: float, workers: int, rate_per_hour: float, budget: float | None = None) -> dict[str, Any]:
    """What a run came to at a rate, and whether it stayed in its budget."""
    value = seconds / 3600 * workers * rate_per_hour
    return {"cost": round(value, 6), "within_budget": budget is None or value <= budget}
