"""Profiling, frequencies, keys and findings: aggregates in as few passes as they need."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import all_of, col
from ..functions.types import is_nested


def _groups(df: DataFrame, values: list[Column]) -> tuple[DataFrame, list[Column]]:
    """(i, n, a column of each type): how often value ``i`` is what, null being one too; and each value among these groups.

    One pass, one shuffle, hash groups as wide as one value of each type: several ``count_distinct`` in one aggregate
    make groups as wide as all columns and, beside extremes of texts, sort them.
    """
    kinds = [f.dataType for f in df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).schema]
    slots = list({k.json(): k for k in kinds}.values())
    rows = [F.struct(F.lit(i).alias("i"), *[(v if k == s else F.lit(None).cast(s)).alias(f"v{j}") for j, s in enumerate(slots)]) for i, (v, k) in enumerate(zip(values, kinds, strict=True))]
    found = df.select(F.inline(F.array(*rows)))
    return found.groupBy(*found.columns).agg(F.count("*").alias("n")), [F.when(F.col("i") == i, F.col(f"v{slots.index(k)}")) for i, k in enumerate(kinds)]


def _rows_of(groups: Column) -> Column:
    """Rows behind the groups that a condition names."""
    return F.coalesce(F.sum(F.when(groups, F.col("n"))), F.lit(0))


def profile(df: DataFrame, sensitive: set[str] = frozenset(), exact: bool = False) -> DataFrame:
    """One row per column from one aggregate: counts, distincts, extremes and lengths.

    Sensitive and boolean columns have no extremes; nested ones only counts.
    """
    nested = [is_nested(f.dataType) or isinstance(f.dataType, T.BinaryType) for f in df.schema]
    columns, source = [col(c) for c in df.columns], df
    if exact:  # the same aggregates over the groups of equal values; of nested ones only whether there is one
        source, columns = _groups(df, [F.when(c.isNotNull(), True) if bare else c for c, bare in zip(columns, nested, strict=True)])
    parts = []
    for f, bare, c in zip(df.schema, nested, columns, strict=True):
        shown = not bare and f.name not in sensitive and not isinstance(f.dataType, T.BooleanType)
        text = isinstance(f.dataType, T.StringType)
        n = _rows_of(c.isNotNull()) if exact else F.count(c)
        distinct = F.lit(None).cast("long") if bare else (F.count(c) if exact else F.least(F.approx_count_distinct(c), n))
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                (_rows_of(F.col("i") == 0) if exact else F.count("*")).alias("rows"),
                n.alias("non_null"),
                distinct.cast("long").alias("distinct"),
                (F.min(c).cast("string") if shown else F.lit(None).cast("string")).alias("min"),
                (F.max(c).cast("string") if shown else F.lit(None).cast("string")).alias("max"),
                (F.min(F.length(c)) if text else F.lit(None)).cast("long").alias("min_length"),
                (F.max(F.length(c)) if text else F.lit(None)).cast("long").alias("max_length"),
            )
        )
    return source.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def footer_profile(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(column, rows, non_null, min, max) of numbers, dates and booleans of Parquet files, from their footers alone."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
        names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType | T.DateType | T.BooleanType) and not isinstance(f.dataType, T.DecimalType)]
        row = df.agg(F.count("*").alias("n"), *[g(col(c)).alias(f"{p}{i}") for i, c in enumerate(names) for p, g in (("c", F.count), ("l", F.min), ("h", F.max))])
        parts = [F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"c{i}").alias("non_null"), F.col(f"l{i}").cast("string").alias("min"), F.col(f"h{i}").cast("string").alias("max")) for i, c in enumerate(names)]
        out = row.select(F.inline(F.array(*parts)))
        out._jdf.queryExecution().executedPlan()  # planned while the settings hold
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def frequencies(df: DataFrame, name: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values; ties by value."""
    return df.groupBy(col(name).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(k)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(repeated_keys, rows_involved) among complete keys."""
    groups = df.filter(all_of(col(k).isNotNull() for k in keys)).groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("repeated_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_involved"))


def order_violations(df: DataFrame, earlier: str, later: str) -> DataFrame:
    a, b = col(earlier).try_cast("timestamp"), col(later).try_cast("timestamp")
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("compared"), F.count_if(b < a).alias("violations"))


def outside_accepted(df: DataFrame, name: str, accepted: list, k: int = 20) -> DataFrame:
    """Values that are not accepted; numbers are compared as numbers."""
    value = col(name)
    numbers = all(isinstance(a, int | float) and not isinstance(a, bool) for a in accepted)
    test = value.try_cast("double").isin([float(a) for a in accepted]) if numbers else value.cast("string").isin([str(a) for a in accepted])
    return frequencies(df.filter(value.isNotNull() & ~F.coalesce(test, F.lit(False))), name, k)


def exact_distincts(df: DataFrame, names: list[str]) -> DataFrame:
    groups, values = _groups(df, [col(c) for c in names])
    return groups.agg(*[F.count(v).alias(c) for c, v in zip(names, values, strict=True)])


def discover_key(df: DataFrame, max_width: int = 3, names: list[str] | None = None) -> list[str] | None:
    """The smallest combination of columns that is unique and complete.

    A combination is tried only if the product of its distinct counts can reach the row
    count; dates and times count only as a part.
    """
    names = names or [f.name for f in df.schema if not is_nested(f.dataType) and not isinstance(f.dataType, T.DoubleType | T.FloatType)]
    temporal = {f.name for f in df.schema if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)}
    if not names:
        return None
    groups, values = _groups(df, [col(c) for c in names])
    row = groups.agg(_rows_of(F.col("i") == 0).alias("__n"), *[F.count(v).alias(f"d{i}") for i, v in enumerate(values)], *[F.count_if((F.col("i") == i) & v.isNull()).alias(f"z{i}") for i, v in enumerate(values)]).first()
    n = row["__n"]
    if not n:
        return None
    distinct = {c: row[f"d{i}"] for i, c in enumerate(names) if not row[f"z{i}"]}
    for width in range(1, max_width + 1):
        tries = []
        for combo in combinations(distinct, width):
            product = 1
            for c in combo:
                product *= distinct[c]
            if product >= n and not set(combo) <= temporal:
                tries.append(combo)
        if width == 1:
            hits = [c for c in tries if distinct[c[0]] == n]
            if hits:
                return list(hits[0])
            continue
        for at in range(0, len(tries), 8):  # several combinations a pass
            part = tries[at : at + 8]
            got = exact_distincts(df.select(*[F.struct(*[col(c) for c in combo]).alias(f"c{i}") for i, combo in enumerate(part)]), [f"c{i}" for i in range(len(part))]).first()
            for i, combo in enumerate(part):
                if got[f"c{i}"] == n:
                    return list(combo)
    return None


def findings(df: DataFrame, keys: list[str] | None = None, accepted: dict[str, list] | None = None, ordered: list[tuple[str, str]] = ()) -> list[dict]:
    """Typed findings with counts, for a report."""
    out = []
    for r in profile(df).collect():  # one row per column
        if r["rows"] and r["non_null"] == 0:
            out.append({"kind": "empty_column", "column": r["column"], "count": r["rows"]})
        elif r["non_null"] < r["rows"]:
            out.append({"kind": "nulls", "column": r["column"], "count": r["rows"] - r["non_null"]})
        if r["rows"] > 1 and r["distinct"] == 1 and r["non_null"] == r["rows"]:
            out.append({"kind": "constant", "column": r["column"], "count": r["rows"]})
    if keys:
        d = duplicate_keys(df, keys).first()
        if d["repeated_keys"]:
            out.append({"kind": "duplicate_keys", "column": ",".join(keys), "count": d["rows_involved"]})
    for name, values in (accepted or {}).items():
        n = sum(r["n"] for r in outside_accepted(df, name, values).collect())
        if n:
            out.append({"kind": "outside_accepted", "column": name, "count": n})
    for a, b in ordered:
        n = order_violations(df, a, b).first()["violations"]
        if n:
            out.append({"kind": "order_violation", "column": f"{a},{b}", "count": n})
    return out


# fixed values: words and phrases of column names that tell personal data
PII_WORDS = frozenset(
    "email phone mobile telephone cellphone ssn nin passport dob birthdate birthday iban ip ipaddress ipv4 ipv6 postcode zip zipcode postal address street "
    "surname firstname lastname fullname tin pan".split()
)
PII_PHRASES = (
    "first name", "last name", "full name", "given name", "family name", "middle name", "maiden name", "customer name", "rider name", "driver name",
    "user name", "contact name", "person name", "date of birth", "birth date", "credit card", "card number", "cc number", "national id", "tax id",
    "social security", "cell number", "cell phone", "license number", "licence number", "drivers license", "driver license", "drivers licence",
    "driving licence", "account number", "sort code", "routing number", "e mail",
)

PII_PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.]+$",
    "phone": r"^\+?[\d\s().-]{7,20}$",
    "ipv4": r"^\d{1,3}(\.\d{1,3}){3}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$",
    "card": r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}$",
}


def pii_by_name(names: list[str]) -> list[str]:
    """Columns whose names hold a telling word or phrase as whole words; a bare ``name`` counts beside another such column."""
    import re

    def telling(name: str) -> bool:
        words = [w.lower() for w in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+", name)]
        phrase = f" {' '.join(words)} "
        return bool(PII_WORDS.intersection(words)) or any(f" {p} " in phrase for p in PII_PHRASES)

    found = {n for n in names if telling(n)}
    return [n for n in names if n in found or (n.lower() == "name" and found)]


def pii_by_value(df: DataFrame, share: float = 0.8) -> DataFrame:
    """(column, kind, ratio) of text columns whose values mostly look like personal data."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, kind string, ratio double")
    parts = [
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), (F.count_if(col(c).rlike(p)) / F.nullif(F.count(col(c)), F.lit(0))).alias("ratio"))
        for c in texts
        for k, p in PII_PATTERNS.items()
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p")).filter(F.col("ratio") >= share)


def extract_patterns(df: DataFrame, text: str, patterns: dict[str, str], group: int = 0) -> DataFrame:
    """Fields from texts by regular expressions; null where nothing is found."""
    found: dict[str, Column] = {n: F.nullif(F.regexp_extract(col(text), p, group), F.lit("")) for n, p in patterns.items()}
    return df.withColumns(found)
