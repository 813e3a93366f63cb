"""Generated frames: the date dimension and synthetic rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..functions.types import spark_type
from .schema import Field


def _easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by J.-M. Oudin's rule of 1940: the Sunday after the paschal full moon."""
    whole = lambda x, n: F.floor(x / F.lit(n))
    century, golden = whole(year, 100), year % 19
    lunar = century - whole(century, 4) - whole(century - whole(century - 17, 25), 3)
    epact = (lunar + 19 * golden + 15) % 30
    late = whole(epact, 28)
    moon = epact - late * (1 - late * F.floor(F.lit(29) / (epact + 1)) * whole(21 - golden, 11))  # days from 21 March to the full moon
    weekday = (year + whole(year, 4) + moon + 2 - century + whole(century, 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (1 = Sunday) of a month; -1 is the last."""
    if n > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, ((weekday - F.dayofweek(first) + 7) % 7 + 7 * (n - 1)).cast("int"))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, ((F.dayofweek(last) - weekday + 7) % 7).cast("int"))


def _holiday(d: Column, country: str) -> Column:
    y, md = F.year(d), F.date_format(d, "MM-dd")
    e = _easter(y)
    if country == "GB":
        named = [
            (md == "01-01", "New Year's Day"), (d == F.date_sub(e, 2), "Good Friday"), (d == F.date_add(e, 1), "Easter Monday"), (d == _nth(y, 5, 2, 1), "Early May Bank Holiday"),
            (d == _nth(y, 5, 2, -1), "Spring Bank Holiday"), (d == _nth(y, 8, 2, -1), "Summer Bank Holiday"), (md == "12-25", "Christmas Day"), (md == "12-26", "Boxing Day"),
        ]
    elif country == "US":
        named = [
            (md == "01-01", "New Year's Day"), (d == _nth(y, 1, 2, 3), "Martin Luther King Jr. Day"), (d == _nth(y, 2, 2, 3), "Presidents' Day"), (d == _nth(y, 5, 2, -1), "Memorial Day"),
            (md == "06-19", "Juneteenth"), (md == "07-04", "Independence Day"), (d == _nth(y, 9, 2, 1), "Labor Day"), (d == _nth(y, 10, 2, 2), "Columbus Day"),
            (md == "11-11", "Veterans Day"), (d == _nth(y, 11, 5, 4), "Thanksgiving Day"), (md == "12-25", "Christmas Day"),
        ]
    else:
        return F.lit(None).cast("string")
    out: Column = F.lit(None).cast("string")
    for test, name in reversed(named):
        out = F.when(test, name).otherwise(out)
    return out


def date_dimension(spark: SparkSession, start: str, end: str, country: str = "GB", fiscal_start: int = 4, today: str | None = None) -> DataFrame:
    """One row per day with calendar, ISO, fiscal and holiday columns; relative ones with ``today``."""
    d = F.col("date")
    fiscal_year = F.when(F.month(d) >= fiscal_start, F.year(d) + (1 if fiscal_start > 1 else 0)).otherwise(F.year(d))
    fiscal_month = (F.month(d) - fiscal_start + 12) % 12 + 1
    weekend = F.dayofweek(d).isin(1, 7)
    base = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    out = base.withColumn("holiday_name", _holiday(d, country)).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "date",
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "MMM").alias("month_short"), F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "EEE").alias("day_short"),
        (F.weekday(d) + 1).alias("day_of_week"), F.dayofyear(d).alias("day_of_year"), F.weekofyear(d).alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.trunc(d, "quarter").alias("quarter_start"), F.trunc(d, "year").alias("year_start"),
        (d == F.trunc(d, "month")).alias("is_month_start"), (d == F.last_day(d)).alias("is_month_end"),
        weekend.alias("is_weekend"), (~weekend).alias("is_weekday"),
        fiscal_year.alias("fiscal_year"), F.ceil(fiscal_month / 3).cast("int").alias("fiscal_quarter"), fiscal_month.cast("int").alias("fiscal_month"),
        "holiday_name", F.col("holiday_name").isNotNull().alias("is_holiday"), (~weekend & F.col("holiday_name").isNull()).alias("is_working_day"),
        ((F.year(d) % 4 == 0) & ((F.year(d) % 100 != 0) | (F.year(d) % 400 == 0))).alias("is_leap_year"),
    )
    if today:
        t = F.lit(today).cast("date")
        out = out.withColumns({
            "days_from_today": F.datediff(d, t), "is_today": d == t, "is_past": d < t, "is_current_month": F.trunc(d, "month") == F.trunc(t, "month"), "is_current_year": F.year(d) == F.year(t),
        })
    return out


def _uniform(seed: int, name: str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64("__id", F.lit(seed), F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _value(f: Field, seed: int, reference: dict[str, list]) -> Column:
    """A value that satisfies the field's declarations."""
    u = _uniform(seed, f.name)
    how = f.extra.get("distribution") or {}
    choices = list(reference.get(f.name) or f.accepted_values)
    if choices:
        weights = how.get("weights")
        if weights:
            total, at, out = float(sum(weights)), 0.0, F.lit(choices[-1])
            for c, w in reversed(list(zip(choices, [sum(weights[: i + 1]) / total for i in range(len(weights))], strict=True))):
                out = F.when(u < w, F.lit(c)).otherwise(out)
            return out
        return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.floor(u * len(choices)) + 1).cast("int"))
    kind = (f.type or "string").lower()
    low, high = f.min if f.min is not None else 0, f.max if f.max is not None else (f.min or 0) + 1000
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * _uniform(seed + 1, f.name))
    match how.get("kind"):
        case "normal":
            x = F.lit(float(how.get("mean", (low + high) / 2))) + normal * float(how.get("sd", 1))
        case "lognormal":
            x = F.exp(F.lit(float(how.get("mean", 0))) + normal * float(how.get("sd", 1)))
        case "bimodal":
            x = F.when(_uniform(seed + 2, f.name) < how.get("share", 0.5), F.lit(float(how["modes"][0]))).otherwise(float(how["modes"][1])) + normal * float(how.get("sd", 1))
        case _:
            x = low + u * (high - low)
    x = F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))
    if kind in ("date",):
        return F.date_add(F.lit(str(f.extra.get("start", "2024-01-01"))).cast("date"), F.floor(u * 365).cast("int"))
    if kind.startswith("timestamp"):
        return F.timestamp_seconds(F.unix_timestamp(F.lit(str(f.extra.get("start", "2024-01-01"))).cast("timestamp")) + F.floor(u * 365 * 86400))
    if kind == "boolean":
        return u < 0.5
    if spark_type(kind) is not None and spark_type(kind).typeName() != "string":
        return (F.floor(x) if spark_type(kind).typeName() in ("byte", "short", "integer", "long") else F.round(x, 2)).cast(spark_type(kind))
    if "email" in f.name.lower():
        return F.concat(F.lit("user"), col("__id").cast("string"), F.lit("@example.com"))
    return F.substring(F.concat(F.lit(f.name + "_"), col("__id").cast("string")), 1, f.max_length or 1 << 20)


def synthesize(spark: SparkSession, fields: list[Field], rows: int, keys: list[str] = (), invalid_ratio: float = 0.0, seed: int = 1, reference: dict[str, list[Any]] | None = None) -> DataFrame:
    """Rows that satisfy the declarations; a share breaks one of them and says which in ``_dc_test_case``."""
    base = spark.range(rows).withColumnRenamed("id", "__id")
    out: dict[str, Column] = {}
    for f in fields:
        kind = spark_type(f.type)
        out[f.name] = col("__id").cast(kind) if f.name in keys and kind is not None else _value(f, seed, reference or {})
    df = base.select("__id", *[v.alias(n) for n, v in out.items()])
    breakable = [(f, how) for f in fields for how in _breaks(f)]
    case: Column = F.lit(None).cast("string")
    if breakable and invalid_ratio > 0:
        pick = F.floor(_uniform(seed + 5, "break") * len(breakable))
        hit = _uniform(seed + 6, "hit") < invalid_ratio
        df = df.withColumn("__b", F.when(hit, pick).cast("int"))
        for i, (f, (name, bad)) in enumerate(breakable):
            df = df.withColumn(f.name, F.when(F.col("__b") == i, bad.cast(df.schema[f.name].dataType)).otherwise(col(f.name)))
            case = F.when(F.col("__b") == i, f"{f.name}: {name}").otherwise(case)
    return df.withColumn("_dc_test_case", case).drop("__id", "__b")


def _breaks(f: Field) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    if f.required:
        out.append(("missing", F.lit(None)))
    if f.min is not None:
        out.append(("below minimum", F.lit(f.min) - 1))
    if f.max is not None:
        out.append(("above maximum", F.lit(f.max) + 1))
    if f.accepted_values and all(isinstance(v, str) for v in f.accepted_values):
        out.append(("not accepted", F.lit("__invalid__")))
    if f.max_length:
        out.append(("too long", F.repeat(F.lit("x"), F.lit(f.max_length + 1))))
    return out
