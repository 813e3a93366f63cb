"""Incremental reads: where the last run stopped, as a predicate for the scan."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import all_of, any_of, col

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def lookback(text: str | int, now: datetime) -> datetime:
    """``now`` less a period like "7 days" or "2 months"; a bare number is seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*?)s?\s*", str(text).lower())
    if not m:
        raise ValueError(f"not a period: {text!r}")
    n, unit = int(m[1]), m[2] or "second"
    if unit in ("month", "year"):
        months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        return now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))
    if unit not in UNITS:
        raise ValueError(f"not a unit: {unit!r}")
    return now - timedelta(seconds=n * UNITS[unit])


@dataclass(frozen=True)
class Boundary:
    """A window of rows to read; ``start`` is excluded where it is a stored watermark."""

    field: str
    start: Any = None
    stop: Any = None
    start_excluded: bool = False
    date_parts: tuple[str, ...] = ()
    static: dict[str, Any] = field(default_factory=dict, hash=False)

    def predicate(self) -> Column:
        """Static partition filters first, then the window; pushed to the scan.

        Over year, month and day columns the bounds are written column by column, so that partitions are pruned.
        """
        parts = [col(k).isin(list(v)) if isinstance(v, list | tuple | set) else col(k) == F.lit(v) for k, v in self.static.items()]
        if self.date_parts:
            if self.start is not None:
                parts.append(self._lexicographic(self.start, ">="))
            if self.stop is not None:
                parts.append(self._lexicographic(self.stop, "<="))
        else:
            c = col(self.field)
            if self.start is not None:
                parts.append(c > F.lit(self.start) if self.start_excluded else c >= F.lit(self.start))
            if self.stop is not None:
                parts.append(c <= F.lit(self.stop))
        return all_of(parts)

    def _lexicographic(self, at: date, how: str) -> Column:
        values = [at.year, at.month, at.day][: len(self.date_parts)]
        names = [col(n) for n in self.date_parts]
        outer = names[0] >= values[0] if how == ">=" else names[0] <= values[0]  # what partition pruning can use
        steps = []
        for i, v in enumerate(values):
            last = i == len(values) - 1
            here = (names[i] >= v if last else names[i] > v) if how == ">=" else (names[i] <= v if last else names[i] < v)
            steps.append(all_of([*(names[j] == values[j] for j in range(i)), here]))
        return outer & any_of(steps)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate())


def max_target(target: DataFrame | None, field: str, now: datetime, default_from: Any = None, default_days: int = 90) -> Boundary:
    """After the largest value in the target; an empty target starts at ``default_from`` or some days ago."""
    top = target.agg(F.max(col(field))).first()[0] if target is not None else None
    if top is None:
        return Boundary(field, default_from if default_from is not None else now - timedelta(days=default_days))
    return Boundary(field, top, start_excluded=True)


def pipeline_log(runs: DataFrame, dataset: str, field: str = "_metadata.file_modification_time") -> Boundary:
    """After the newest file of the last good run; failed, empty and reprocessing runs don't count.  Typed, never compared as text."""
    good = runs.filter((F.col("dataset") == dataset) & (F.col("status") != "failed") & ~F.coalesce(F.col("stage").isin("no_new_data", "reprocess"), F.lit(False)))
    top = good.agg(F.max(F.col("max_source_mtime").cast("timestamp"))).first()[0]
    return Boundary(field, top, start_excluded=True)


def date_range(field: str, start: Any, stop: Any, date_parts: tuple[str, ...] = (), static: dict | None = None) -> Boundary:
    return Boundary(field, start, stop, date_parts=date_parts, static=static or {})


def from_lookback(field: str, period: str, now: datetime) -> Boundary:
    return Boundary(field, lookback(period, now))


class Manifest:
    """Processed partitions, one small file for each that was done, on any file system."""

    def __init__(self, spark: SparkSession, path: str):
        from .sinks import Files

        self.files, self.path = Files(spark), path.rstrip("/")

    def done(self) -> set[str]:
        return {unquote(n) for n in self.files.names(self.path) if not n.startswith((".", "_"))}

    def pending(self, partitions: list[str]) -> list[str]:
        done = self.done()
        return [p for p in partitions if p not in done]

    def add(self, partitions: list[str]) -> None:
        for p in partitions:
            self.files.create(f"{self.path}/{quote(p, safe='=')}", "")


def resolve(config: dict, now: datetime, target: DataFrame | None = None, runs: DataFrame | None = None, **over) -> Boundary | None:
    """The boundary of a source's configuration; arguments come before the contract."""
    c = config | {k: v for k, v in over.items() if v is not None}
    strategy = c.get("watermark_strategy") or c.get("strategy")
    if c.get("reprocess_from") or c.get("reprocess_to"):
        return date_range(c["watermark_field"], c.get("reprocess_from"), c.get("reprocess_to"))
    match strategy:
        case None:
            return None
        case "max_target":
            return max_target(target, c["watermark_field"], now, c.get("default_from"))
        case "pipeline_log":
            if c.get("type") in ("table", "database"):
                raise ValueError("pipeline_log follows file times; a table has none")
            return pipeline_log(runs, c["dataset"])
        case "date_range":
            return date_range(c["watermark_field"], c.get("from"), c.get("to"), tuple(c.get("date_parts") or ()), c.get("partition_filters"))
        case "lookback":
            return from_lookback(c["watermark_field"], c["lookback"], now)
        case "delta_version":
            if c.get("type") in ("landing", "files"):
                raise ValueError("delta_version follows table versions; files have none")
            return Boundary("_commit_version", c.get("last_version"), start_excluded=True)
    raise ValueError(f"unknown watermark strategy: {strategy!r}")
