"""Row rules: a contract's declarations as predicates, and the split of good and bad rows.

A row is good only if every rule is TRUE; FALSE and NULL reject it.  All rules of a
phase are evaluated in one projection.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import all_of, any_of, as_timestamp, col
from ..functions.types import spark_type

ERRORS, CATEGORIES, STATE, REPROCESSED = "_dc_errors", "_dc_categories", "quarantine_state", "quarantine_reprocessed"
#: columns that readers fill for records they could not read
READ_ERROR = "__type_err__record"


@dataclass(frozen=True)
class Rule:
    name: str
    #: what the message shows
    sql: str
    #: predicate; for rules over a reference, over the column that :attr:`needs` adds
    test: Column
    category: str = "validity"
    severity: str = "error"
    phase: str = "pre"
    #: adds what the predicate needs (a join), before the projection
    needs: Any = None

    def message(self) -> str:
        return f"[{self.phase}] Rule failed: {self.name} ({self.sql})"


def not_null(field: str, name: str | None = None, **kw) -> Rule:
    return Rule(name or f"{field}_not_null", f"{field} IS NOT NULL", col(field).isNotNull(), kw.pop("category", "completeness"), **kw)


def required(field: str, **kw) -> Rule:
    return Rule(f"{field}_required", f"{field} IS NOT NULL", col(field).isNotNull(), "completeness", **kw)


def accepted_values(field: str, values: Iterable[Any], **kw) -> Rule:
    values = list(values)
    return Rule(kw.pop("name", None) or f"{field}_accepted_values", f"{field} IN {tuple(values)}", col(field).isin(values), **kw)


def regex_match(field: str, pattern: str, **kw) -> Rule:
    return Rule(kw.pop("name", None) or f"{field}_regex", f"{field} matches {pattern}", col(field).cast("string").rlike(pattern), **kw)


def in_range(field: str, low: Any = None, high: Any = None, inclusive: bool = True, numeric_text: bool = False, **kw) -> Rule:
    value = col(field).try_cast("double") if numeric_text else col(field)
    tests, shown = [], []
    if low is not None:
        tests.append(value >= F.lit(low) if inclusive else value > F.lit(low))
        shown.append(f"{field} {'>=' if inclusive else '>'} {low}")
    if high is not None:
        tests.append(value <= F.lit(high) if inclusive else value < F.lit(high))
        shown.append(f"{field} {'<=' if inclusive else '<'} {high}")
    return Rule(kw.pop("name", None) or f"{field}_range", " AND ".join(shown), all_of(tests), **kw)


def max_length(field: str, n: int, **kw) -> Rule:
    return Rule(kw.pop("name", None) or f"{field}_max_length", f"LENGTH({field}) <= {n}", col(field).isNull() | (F.length(col(field)) <= n), **kw)


def custom(name: str, sql: str, category: str = "correctness", severity: str = "error", phase: str = "pre") -> Rule:
    return Rule(name, sql, F.expr(sql), category, severity, phase)


def milestone(start: str, end: str, **kw) -> Rule:
    a, b = as_timestamp(col(start)), as_timestamp(col(end))
    return Rule(f"{end}_after_{start}", f"{end} >= {start}", col(start).isNull() | col(end).isNull() | (b >= a), "consistency", **kw)


def referential_integrity(field: str, ref: DataFrame, key: str, name: str | None = None, **kw) -> Rule:
    """The field's value is a key of the reference; a null value is rejected."""
    name = name or f"{field}_referential_integrity"
    flag = f"__ri_{name}"
    keys = ref.select(col(key).alias("__rk")).filter("__rk is not null").distinct().withColumn(flag, F.lit(True))

    def add(df: DataFrame) -> DataFrame:
        return df.join(keys, col(field) == F.col("__rk"), "left").drop("__rk")

    return Rule(name, f"{field} IN (SELECT {key} FROM reference)", F.col(f"`{flag}`").isNotNull(), "consistency", needs=(add, [flag]), **kw)


def lifecycle_window(
    event_ts: str, event_key: str, ref: DataFrame, ref_key: str, start: str, end: str, name: str | None = None, **kw
) -> Rule:
    """The event lies in its key's window [max(start), max(end) or open]; without a reference row it is rejected."""
    name = name or f"{event_ts}_lifecycle_window"
    a, b = f"__lo_{name}", f"__hi_{name}"
    windows = ref.groupBy(col(ref_key).alias("__wk")).agg(F.max(as_timestamp(col(start))).alias(a), F.max(as_timestamp(col(end))).alias(b))

    def add(df: DataFrame) -> DataFrame:
        return df.join(windows, col(event_key) == F.col("__wk"), "left").drop("__wk")

    at, lo, hi = as_timestamp(col(event_ts)), F.col(f"`{a}`"), F.col(f"`{b}`")
    test = (at >= lo) & (at <= F.coalesce(hi, F.lit("9999-12-31").cast("timestamp")))
    return Rule(name, f"{event_ts} within window of {event_key}", test, "timeliness", needs=(add, [a, b]), **kw)


def dedup_keys_present(keys: list[str], **kw) -> Rule:
    return Rule("__".join(keys) + "_required_for_dedup", " AND ".join(f"{k} IS NOT NULL" for k in keys), all_of(col(k).isNotNull() for k in keys), "completeness", **kw)


def type_mismatch(field: str, kind: str) -> tuple[str, Column]:
    """(message, is it mismatched) for a raw column that is to be cast."""
    wanted = spark_type(kind)
    bad = col(field).isNotNull() & col(field).try_cast(wanted).isNull()
    if wanted.typeName() == "decimal" and "(" in kind:
        return f"Type Mismatch: {field} exceeds {kind} or is not a number", bad
    return f"Type Mismatch: {field} cannot be cast to {kind}", bad


def errors_of(rules: list[Rule], extra: list[tuple[Column, str]] = ()) -> tuple[Column, Column]:
    """(errors, categories) arrays: the messages of the rules that are not TRUE."""
    failed = [(~F.coalesce(r.test, F.lit(False)), r.message(), r.category) for r in rules]
    failed = [(c, m, "schema") for c, m in extra] + failed
    if not failed:
        none = F.array().cast("array<string>")
        return none, none
    pairs = [F.when(c, F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"))) for c, m, k in failed]
    held = F.array_compact(F.array(*pairs))
    return held.getField("m"), held.getField("k")


def evaluate(df: DataFrame, rules: list[Rule], extra: list[tuple[Column, str]] = ()) -> DataFrame:
    """``df`` with the error arrays; helper columns of reference rules are gone again."""
    own = df.columns
    for r in rules:
        if r.needs:
            df = r.needs[0](df)
    errors, categories = errors_of(rules, list(extra))
    if READ_ERROR in own:
        unread = col(READ_ERROR)
        errors = F.when(unread.isNotNull(), F.concat(F.array(unread), errors)).otherwise(errors)
        categories = F.when(unread.isNotNull(), F.concat(F.array(F.lit("schema")), categories)).otherwise(categories)
        own = [c for c in own if c != READ_ERROR]
    return df.select(*[col(c) for c in own], errors.alias(ERRORS), categories.alias(CATEGORIES))


def split(evaluated: DataFrame, include_reason: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of an evaluated frame."""
    bad_row = F.size(col(ERRORS)) > 0
    good = evaluated.filter(~bad_row).drop(ERRORS, CATEGORIES)
    bad = evaluated.filter(bad_row).withColumns({STATE: F.lit("active"), REPROCESSED: F.lit(False)})
    return good, bad if include_reason else bad.drop(ERRORS, CATEGORIES)


def failure_counts(bad: DataFrame) -> DataFrame:
    """(rule, failed_rows): how often each rule rejected a row."""
    one = bad.select(F.explode(col(ERRORS)).alias("e"))
    name = F.coalesce(F.nullif(F.regexp_extract("e", r"Rule failed: (.+?) \(", 1), F.lit("")), F.regexp_extract("e", r"^([^:]+)", 1))
    return one.groupBy(name.alias("rule")).agg(F.count("*").alias("failed_rows"))


def check_in_place(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, rows_evaluated, failed_rows) by one aggregate, without a split."""
    for r in rules:
        if r.needs:
            df = r.needs[0](df)
    sums = [F.sum(F.when(F.coalesce(r.test, F.lit(False)), 0).otherwise(1)).alias(f"f{i}") for i, r in enumerate(rules)]
    one = df.agg(F.count("*").alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("n").alias("rows_evaluated"), F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("long").alias("failed_rows")) for i, r in enumerate(rules)])
    return one.select(F.inline(rows))


def rows_at_fault(df: DataFrame, rules: list[Rule]) -> Column:
    return any_of(~F.coalesce(r.test, F.lit(False)) for r in rules)
