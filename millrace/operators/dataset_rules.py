"""Dataset rules: predicates over aggregates of the good rows.

Rules that are built in are columns of one shared aggregate, so that any number of
them is one job.  Rules in SQL text run as statements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col, run_sql


@dataclass(frozen=True)
class DatasetRule:
    name: str
    #: aggregate over the frame; None for a rule in SQL text
    agg: Column | None = None
    #: rows that the aggregate is over; all, if None
    where: Column | None = None
    sql: str | None = None
    less_than: float | None = None
    greater_than: float | None = None
    between: tuple[float, float] | None = None
    #: columns whose groups are judged on their own
    scope: tuple[str, ...] = ()

    def holds(self, value: Column) -> Column:
        """TRUE where a value satisfies the rule; null stays null."""
        out = value.isNotNull() | F.lit(None).cast("boolean")
        if self.less_than is not None:
            out = out & (value < self.less_than)
        if self.greater_than is not None:
            out = out & (value > self.greater_than)
        if self.between is not None:
            out = out & value.between(*self.between)
        return out


def unique(keys: str | list[str], **kw) -> DatasetRule:
    """Rows less distinct keys must be none; a single null key counts as repeated, as COUNT(DISTINCT) skips it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    one = col(keys[0]) if len(keys) == 1 else F.concat_ws("|#|", *[col(k).cast("string") for k in keys])
    return DatasetRule(kw.pop("name", None) or "_".join(keys) + "_unique", F.count("*") - F.count_distinct(one), less_than=1, **kw)


def null_ratio(field: str, max_ratio: float, **kw) -> DatasetRule:
    """Share of nulls below ``max_ratio``; above 1 it is read as a percentage."""
    limit = max_ratio / 100 if max_ratio > 1 else max_ratio
    return DatasetRule(kw.pop("name", None) or f"{field}_null_ratio", F.avg(F.when(col(field).isNull(), 1.0).otherwise(0.0)), less_than=limit, **kw)


def row_count_between(low: int | None = None, high: int | None = None, **kw) -> DatasetRule:
    name = kw.pop("name", None) or "row_count"
    if low is not None and high is not None:
        return DatasetRule(name, F.count("*"), between=(low, high), **kw)
    return DatasetRule(name, F.count("*"), greater_than=None if low is None else low - 1, less_than=None if high is None else high + 1, **kw)


def aggregate(name: str, expression: str, **kw) -> DatasetRule:
    return DatasetRule(name, F.expr(expression), **kw)


def statement(name: str, sql: str, **kw) -> DatasetRule:
    """``SELECT <aggregate> FROM source [WHERE ...]``.

    The simple form becomes an aggregate over filtered rows, which can be evaluated per group;
    anything else runs as it is.
    """
    m = re.fullmatch(r"\s*SELECT\s+(.+?)\s+FROM\s+source(?:\s+WHERE\s+(.+?))?\s*;?\s*", sql, re.I | re.S)
    if m and not re.search(r"\bselect\b|\bover\s*\(", m[0][m[0].lower().index("select") + 6 :], re.I) and not re.search(r"\b(?:group|order|having|limit|union|intersect|except|join)\b", m[2] or "", re.I):
        return DatasetRule(name, F.expr(m[1]), F.expr(m[2]) if m[2] else None, **kw)
    return DatasetRule(name, None, sql=sql, **kw)


@dataclass(frozen=True)
class DatasetResult:
    name: str
    value: Any
    passed: bool | None


def check(df: DataFrame, rules: list[DatasetRule], links: dict[str, DataFrame] | None = None, deferred: tuple[str, ...] = ()) -> list[DatasetResult]:
    """Results of all rules.  A null value passes only if no row was there to look at.

    Rules named in ``deferred`` (over columns that the write adds) are recorded as neither.
    """
    now = [r for r in rules if r.name not in deferred]
    out: dict[str, DatasetResult] = {r.name: DatasetResult(r.name, None, None) for r in rules if r.name in deferred}
    for where in dict.fromkeys(str(r.where) for r in now if r.agg is not None):  # one aggregate for all rules over the same rows
        built = [r for r in now if r.agg is not None and str(r.where) == where]
        rows = df if built[0].where is None else df.filter(built[0].where)
        row = rows.agg(F.count("*").alias("n"), *[r.agg.alias(f"v{i}") for i, r in enumerate(built)])
        shown = row.select("n", *[F.struct(F.col(f"v{i}").alias("v"), r.holds(F.col(f"v{i}")).alias("ok")).alias(f"r{i}") for i, r in enumerate(built)]).first()
        for i, r in enumerate(built):
            v, ok = shown[f"r{i}"]["v"], shown[f"r{i}"]["ok"]
            out[r.name] = DatasetResult(r.name, v, shown["n"] == 0 if v is None else bool(ok))
    for r in now:
        if r.agg is None:
            frame = run_sql(df, r.sql, {"source": df} | (links or {}))
            value = frame.columns[0]
            row = frame.select(col(value).alias("v"), r.holds(col(value)).alias("ok")).first()
            v = row["v"] if row else None
            passed = _no_rows(df, r.sql, links) if v is None else bool(row["ok"])
            out[r.name] = DatasetResult(r.name, v, passed)
    return [out[r.name] for r in rules]


def _no_rows(df: DataFrame, sql: str, links: dict[str, DataFrame] | None) -> bool:
    m = re.search(r"\bFROM\b.*$", sql, re.I | re.S)
    if not m or re.search(r"\bGROUP\s+BY\b|\bHAVING\b", m[0], re.I):
        return False
    counted = run_sql(df, f"SELECT count(*) AS n {m[0].rstrip().rstrip(';')}", {"source": df} | (links or {}))
    return counted.first()["n"] == 0


def split_by_scope(df: DataFrame, rule: DatasetRule) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of the groups that satisfy a scoped rule, and the others.

    Null is a group like any other; a group without any row that the rule looks at satisfies it.
    """
    keys = list(rule.scope)
    value = F.col("__value")
    judged = (df if rule.where is None else df.filter(rule.where)).groupBy(*[col(k).alias(f"__g_{k}") for k in keys]).agg(rule.agg.alias("__value"))
    failing = judged.filter(~F.coalesce(rule.holds(value), F.lit(False))).drop("__value")
    same = [col(k).eqNullSafe(col(f"__g_{k}")) for k in keys]
    return df.join(failing, same, "left_anti"), df.join(failing, same, "left_semi")
