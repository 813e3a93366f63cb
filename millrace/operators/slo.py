"""Service levels and row-count anomalies."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_timestamp, col


def freshness(df: DataFrame, field: str, threshold_seconds: float, now: Column) -> DataFrame:
    """(newest, age_seconds, passed, reason); an empty frame fails."""
    newest = df.agg(F.max(as_timestamp(col(field))).alias("newest"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("newest")) / F.lit(1e6)
    out = newest.withColumn("age_seconds", age)
    return out.withColumns({"passed": F.coalesce(F.col("age_seconds") <= threshold_seconds, F.lit(False)), "reason": F.when(F.col("newest").isNull(), "no_data_or_threshold")})


def availability(df: DataFrame, field: str, threshold_percent: float) -> DataFrame:
    """(available_percent, passed): share of rows with a value."""
    out = df.agg((F.count(col(field)) * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("available_percent"))
    return out.withColumn("passed", F.coalesce(F.col("available_percent") >= threshold_percent, F.lit(False)))


_PERIOD = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def interval_of(period: str) -> Column:
    """An ISO-8601 period as an interval column."""
    m = _PERIOD.fullmatch(period)
    if not m or not any(m.groups()):
        raise ValueError(f"not an ISO-8601 period: {period!r}")
    y, mo, w, d, h, mi, s = (int(x or 0) for x in m.groups())
    return F.make_interval(F.lit(y), F.lit(mo), F.lit(w), F.lit(d), F.lit(h), F.lit(mi), F.lit(s))


def seconds_of(period: str | float) -> float:
    """Seconds of an ISO-8601 period without months and years, or of ``<n>s|m|h|d``."""
    if isinstance(period, int | float):
        return float(period)
    short = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([smhd])", period)
    if short:
        return float(short[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[short[2]]
    m = _PERIOD.fullmatch(period)
    if not m or not any(m.groups()) or m[1] or m[2]:
        raise ValueError(f"not a period of fixed length: {period!r}")
    w, d, h, mi, sec = (int(x or 0) for x in m.groups()[2:])
    return float(((w * 7 + d) * 24 + h) * 3600 + mi * 60 + sec)


def retention(df: DataFrame, field: str, period: str, now: Column) -> DataFrame:
    """(oldest, cutoff, expired_rows, passed)."""
    cutoff = now.cast("timestamp") - interval_of(period)
    at = as_timestamp(col(field))
    out = df.agg(F.min(at).alias("oldest"), F.count_if(at < cutoff).alias("expired_rows"))
    return out.withColumns({"cutoff": cutoff, "passed": F.coalesce(F.col("oldest") >= cutoff, F.lit(True))})


def quality_gate(good: int, quarantined: int, min_good: float | None = None, max_quarantine: float | None = None) -> str:
    """none without rows, fail or warn without good rows, else pass or fail by the ratios."""
    total = good + quarantined
    declared = min_good is not None or max_quarantine is not None
    if total == 0:
        return "none"
    if good == 0:
        return "fail" if declared else "warn"
    ok = (min_good is None or good / total >= min_good) and (max_quarantine is None or quarantined / total <= max_quarantine)
    return "pass" if ok else "fail"


METHODS = ("median", "rolling_average", "seasonal_median")


def row_count_anomaly(
    runs: DataFrame, current: int, at: datetime, dataset: str | None = None, environment: str | None = None, method: str = "median", lookback_runs: int = 30,
    lookback_days: int = 56, min_runs: int = 5, drop_ratio: float = 0.5, spike_ratio: float = 2.0, critical_ratio: float = 0.1,
) -> DataFrame:
    """(baseline, samples, ratio, verdict) of a run's row count against earlier runs of its environment.

    ``runs``: dataset, environment, timestamp, counts_good.  Methods: ``median`` and ``rolling_average`` of the last runs;
    ``seasonal_median`` of the same weekday, or, where that has too few runs, of all runs of the days looked back on.
    Empty runs never count.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    past = runs.filter((F.col("timestamp").cast("timestamp") < F.lit(at).cast("timestamp")) & (F.col("counts_good") > 0))
    if dataset is not None:
        past = past.filter(F.col("dataset") == dataset)
    if environment is not None:
        past = past.filter(F.col("environment").eqNullSafe(F.lit(environment)))
    count = F.col("counts_good").cast("double")
    if method == "seasonal_median":
        past = past.filter(F.col("timestamp").cast("timestamp") >= F.lit(at).cast("timestamp") - F.make_interval(days=F.lit(lookback_days)))
        alike = F.when(F.dayofweek("timestamp") == F.dayofweek(F.lit(at).cast("timestamp")), count)
        found = past.agg(F.median(alike).alias("own"), F.count(alike).alias("n_own"), F.median(count).alias("every"), F.count("*").alias("n_every"))
        seasonal = F.col("n_own") >= max(2, min_runs)
        out = found.select(F.when(seasonal, F.col("own")).otherwise(F.col("every")).alias("baseline"), F.when(seasonal, F.col("n_own")).otherwise(F.col("n_every")).alias("samples"))
    else:
        past = past.orderBy(F.desc("timestamp")).limit(lookback_runs)
        out = past.agg((F.avg if method == "rolling_average" else F.median)(count).alias("baseline"), F.count("*").alias("samples"))
    out = out.withColumn("ratio", F.lit(float(current)) / F.col("baseline"))
    verdict = (
        F.when(F.col("samples") < min_runs, "insufficient_history")
        .when(F.lit(current == 0) | (F.col("ratio") < critical_ratio), "critical")
        .when(F.col("ratio") < drop_ratio, "drop")
        .when(F.col("ratio") > spike_ratio, "spike")
        .otherwise("normal")
    )
    return out.withColumn("verdict", verdict)


def merge_slo(system: dict, contract: dict) -> dict:
    """A contract's settings over its system's, level by level."""
    out = dict(system)
    for k, v in contract.items():
        out[k] = merge_slo(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
