"""The transforms of a contract: each is a function (frame, config, context) -> frame.

The set is closed: an unknown name is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import all_of, any_of, as_date, as_timestamp, col, json_path, run_sql, text_of, try_cast


@dataclass
class Context:
    """What a transform may look at besides its frame."""

    links: dict[str, DataFrame] = field(default_factory=dict)
    #: links that the contract declares small
    broadcast: set[str] = field(default_factory=set)
    dataset: str | None = None
    upstream_run_id: str = "_dc_run_id"

    def link(self, name: str) -> DataFrame:
        if name not in self.links:
            raise KeyError(f"no link named {name!r}; there are {sorted(self.links)}")
        df = self.links[name]
        return F.broadcast(df) if name in self.broadcast else df

    def frames(self, source: DataFrame) -> dict[str, DataFrame]:
        named = dict(self.links)
        if self.dataset:
            named[self.dataset] = source
        return named | {"source": source}


Transform = Callable[[DataFrame, Any, Context], DataFrame]
TRANSFORMS: dict[str, Transform] = {}


def transform(name: str) -> Callable[[Transform], Transform]:
    def add(f: Transform) -> Transform:
        TRANSFORMS[name] = f
        return f

    return add


def _fields(config: Any) -> list[str]:
    if isinstance(config, str):
        return [config]
    if isinstance(config, dict):
        config = config.get("fields") or config.get("columns") or config.get("field") or []
        return [config] if isinstance(config, str) else list(config)
    return list(config)


# -- projection -------------------------------------------------------------
@transform("rename")
def rename(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """{from, to}, {mappings: {old: new}} or {old: new}; absent columns are skipped."""
    pairs = {config["from"]: config["to"]} if "from" in config else dict(config.get("mappings") or config)
    for old, new in pairs.items():
        df = df.withColumnRenamed(old, new)
    return df


@transform("select")
def select(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return df.select(*[col(c) for c in _fields(config)])


@transform("drop")
def drop(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return df.drop(*_fields(config))


@transform("cast")
def cast(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """{column: type}; values that can't be cast become null."""
    kinds = config.get("columns", config)
    return df.withColumns({c: try_cast(col(c), t) for c, t in kinds.items() if c in df.columns})


def _each(df: DataFrame, names: list[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(col(c)) for c in names if c in df.columns})


@transform("trim")
def trim(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    side = config.get("side", "both") if isinstance(config, dict) else "both"
    return _each(df, _fields(config), {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side])


@transform("lower")
def lower(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return _each(df, _fields(config), F.lower)


@transform("upper")
def upper(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return _each(df, _fields(config), F.upper)


@transform("coalesce")
def coalesce(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """First of ``sources`` that is not null, else ``default``; absent sources are skipped."""
    sources = [c for c in config.get("sources") or [config["field"]] if c in df.columns]
    parts = [col(c) for c in sources]
    if config.get("default") is not None:
        parts.append(F.lit(config["default"]))
    return df.withColumn(config.get("output") or config["field"], F.coalesce(*parts)) if parts else df


@transform("map_values")
def map_values(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """Values by a mapping; others keep their value, or take ``default``."""
    value = col(config["field"])
    out: Column = F.lit(config["default"]) if config.get("default") is not None else value
    for old, new in reversed(list(config["mapping"].items())):
        out = F.when(value.cast("string") == str(old), F.lit(new)).otherwise(out)
    return df.withColumn(config.get("output") or config["field"], out)


@transform("split")
def split(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """A delimited text as JSON array text; the delimiter is taken literally."""
    parts = F.split(col(config["field"]), re.escape(config.get("delimiter", ",")), -1)
    return df.withColumn(config.get("output") or config["field"], F.to_json(parts))


@transform("explode")
def explode(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """One row per element of an array or JSON array text; empty and null keep their row."""
    name, out = config["field"], config.get("output") or config["field"]
    value = col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = F.from_json(value, "array<string>")
    if out == name:
        return df.select(*[F.explode_outer(value).alias(name) if c == name else col(c) for c in df.columns])
    return df.select(*[col(c) for c in df.columns if c != out], F.explode_outer(value).alias(out))


@transform("derive")
def derive(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return df.withColumn(config["field"], F.expr(config.get("sql_spark") or config["sql"]))


@transform("bucket")
def bucket(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """Labels by ordered bins: {lt, lte, gt, gte, eq, label}; the first that fits stands."""
    value = col(config["source"])
    tests = {"lt": value.__lt__, "lte": value.__le__, "gt": value.__gt__, "gte": value.__ge__, "eq": value.__eq__}
    out: Column = F.lit(config.get("default")).cast("string")
    for b in reversed(config["bins"]):
        fits = all_of(tests[k](F.lit(b[k])) for k in tests if b.get(k) is not None)
        out = F.when(fits, F.lit(b["label"])).otherwise(out)
    return df.withColumn(config["field"], out)


@transform("date_diff")
def date_diff(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """``to_col - from_col`` in whole days, hours, minutes or seconds."""
    unit = str(config.get("unit", "days")).lower()
    a, b = col(config["from_col"]), col(config["to_col"])
    if unit.startswith("day"):
        out = F.datediff(as_date(b), as_date(a))
    else:
        seconds = F.unix_micros(as_timestamp(b)) - F.unix_micros(as_timestamp(a))
        out = (seconds / F.lit({"hour": 3_600_000_000, "minu": 60_000_000, "seco": 1_000_000}[unit[:4]])).cast("long")
    return df.withColumn(config["field"], out)


@transform("json_extract")
def json_extract(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    out = F.get_json_object(col(config["source"]), json_path(config["path"]))
    if config.get("cast"):
        from ..functions.types import spark_type

        if spark_type(config["cast"]) is None:
            raise ValueError(f"json_extract: unknown type {config['cast']!r}")
        out = try_cast(out, config["cast"])
    return df.withColumn(config["field"], out)


@transform("date_range_explode")
def date_range_explode(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """One row per step from start to end (today, or ``today``, at most); none where start is later."""
    today = F.lit(config["today"]).cast("date") if config.get("today") else F.current_date()
    start = as_date(col(config["start_col"]))
    stop = F.least(F.coalesce(as_date(col(config["end_col"])), today), today) if config.get("end_col") else today
    m = re.fullmatch(r"(\d+)\s*(d|w|mo)", str(config.get("interval", "1d")))
    if not m:
        raise ValueError(f"date_range_explode: interval {config.get('interval')!r} is not Nd, Nw or Nmo")
    unit = {"d": "DAY", "w": "WEEK", "mo": "MONTH"}[m[2]]
    step = F.expr(f"INTERVAL {m[1]} {unit}")
    out = config.get("output") or config.get("field") or "date"
    return df.withColumn(out, F.explode(F.when(start <= stop, F.sequence(start, stop, step))))


@transform("sql")
def sql(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """Any SELECT over ``source`` and the links."""
    text = config if isinstance(config, str) else config.get("sql_spark") or config.get("sql") or config["query"]
    return run_sql(df, text, ctx.frames(df))


@transform("filter")
def filter_(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return df.filter(F.expr(config if isinstance(config, str) else config["sql"]))


# -- joins ------------------------------------------------------------------
@transform("lookup")
def lookup(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """One value column of a link, by an equal key; repeated reference keys fan out."""
    ref = ctx.link(config["reference"]).select(col(config["key"]).alias("__k"), col(config["value"]).alias("__v"))
    value = F.col("__v")
    if config.get("default_value") is not None:
        value = F.coalesce(value, F.lit(config["default_value"]))
    own = [c for c in df.columns if c != config["field"]]
    return df.join(ref, col(config["on"]) == F.col("__k"), "left").select(*[col(c) for c in own], value.alias(config["field"]))


@transform("join")
def join(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """Fields of a link by one equal key: left, inner, right or full."""
    how = str(config.get("type", "left")).lower()
    ref = ctx.link(config["reference"])
    names = list(config.get("fields") or [c for c in ref.columns if c != config["key"]])
    prefix, defaults = config.get("prefix") or "", config.get("defaults") or {}
    right = ref.select(col(config["key"]).alias("__k"), *[col(c).alias(f"__f_{c}") for c in names])
    taken = {prefix + c for c in names}
    out = []
    for c in names:
        value = F.col(f"`__f_{c}`")
        out.append((F.coalesce(value, F.lit(defaults[c])) if c in defaults else value).alias(prefix + c))
    kept = [col(c) for c in df.columns if c not in taken]
    return df.join(right, col(config["on"]) == F.col("__k"), "outer" if how == "full" else how).select(*kept, *out)


# -- aggregation ------------------------------------------------------------
@transform("rollup")
def rollup(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """GROUP BY with named aggregates, and the keys, key counts and upstream runs of each group."""
    groups = [col(c) for c in config.get("group_by") or []]
    out = [F.expr(e).alias(n) for n, e in (config.get("aggregations") or {}).items()]
    keys = config.get("keys")
    if keys:
        keys = [keys] if isinstance(keys, str) else list(keys)
        one = col(keys[0]) if len(keys) == 1 else F.concat_ws("||", *[col(k).cast("string") for k in keys])
        traced = F.collect_set(one) if config.get("distinct", True) else F.collect_list(one)
        out.append(F.sort_array(traced).alias(config.get("rollup_keys_column") or "_dc_rollup_keys"))
        if config.get("rollup_keys_count_column"):
            # of the same set, so that rows aren't expanded for a distinct count
            out.append((F.size(traced).cast("long") if config.get("distinct", True) else F.count(one)).alias(config["rollup_keys_count_column"]))
    run = config.get("upstream_run_id_column") or ctx.upstream_run_id
    if config.get("upstream_run_ids_column") and run in df.columns:
        out.append(F.sort_array(F.collect_set(col(run))).alias(config["upstream_run_ids_column"]))
    if not groups and not out:
        return df
    if not out:
        return df.select(*groups).distinct()
    return df.groupBy(*groups).agg(*out)


_AGG: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "count_distinct": F.count_distinct, "distinct_count": F.count_distinct,
    "first": lambda c: F.first(c, ignorenulls=True), "any_value": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
}


@transform("pivot")
def pivot(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """Listed values of a column as columns, by conditional aggregates in one pass."""
    by = config.get("pivot_col") or config["pivot_cols"][0]
    values = list(config.get("values") or config["pivot_values"])
    cols = list(config.get("value_cols") or [config["value_col"]])
    aliases, aggs = config.get("value_aliases") or {}, config.get("aggs") or {}
    out = []
    for value_col in cols:
        agg = _AGG.get(str(aggs.get(value_col) or config.get("agg") or "first").lower(), _AGG["first"])
        for v in values:
            alias = aliases.get(v) or aliases.get(str(v)) or v
            one = agg(F.when(col(by) == F.lit(v), col(value_col)))
            if config.get("fill_value") is not None:
                one = F.coalesce(one, F.lit(config["fill_value"]))
            name = f"{value_col}{config.get('separator') or '_'}{alias}"
            if config.get("name_template"):
                name = config["name_template"].format(value_col=value_col, pivot_value=v, pivot_alias=alias)
            out.append(one.alias(name))
    return df.groupBy(*[col(c) for c in config.get("id_vars") or []]).agg(*out)


@transform("unpivot")
def unpivot(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """Columns as rows of key and value; null values only with ``include_nulls``."""
    values = list(config.get("value_vars") or config["value_cols"])
    aliases = config.get("value_aliases") or {}
    key, value = config.get("key_field") or "key", config.get("value_field") or "value"
    wide = df.select(*[col(c) for c in config.get("id_vars") or []], *[col(c).alias(str(aliases.get(c) or c)) for c in values])
    out = wide.unpivot(list(config.get("id_vars") or []), [str(aliases.get(c) or c) for c in values], key, value)
    return out if config.get("include_nulls") else out.filter(col(value).isNotNull())


@transform("deduplicate")
def deduplicate(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    """One row per key, the first by ``sort_by``; rows with a blank key all stay.

    Ties go by the other orderable columns, so that reruns agree.
    """
    keys = [config["on"]] if isinstance(config["on"], str) else list(config["on"])
    order = config.get("sort_by")
    if not order:
        raise ValueError("deduplicate needs sort_by: which of several rows stays must be declared")
    order = [order] if isinstance(order, str) else list(order)
    falls = str(config.get("order", "desc")).lower() == "desc"
    by = [col(c).desc_nulls_last() if falls else col(c).asc_nulls_last() for c in order]
    by += [col(f.name).desc_nulls_last() if falls else col(f.name).asc_nulls_last() for f in df.schema if f.name not in order and _orderable(f.dataType)]
    blank = any_of(col(k).isNull() for k in keys)
    place = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*by))
    # blank keys are kept out of the window: they would all meet in one partition
    kept = df.filter(~blank).withColumn("__n", place).filter("__n = 1").drop("__n")
    if all(not df.schema[k].nullable for k in keys):
        return kept
    return kept.unionByName(df.filter(blank))


@transform("deduplicate_by_latest")
def deduplicate_by_latest(df: DataFrame, config: Any, ctx: Context) -> DataFrame:
    return deduplicate(df, {"on": config.get("on") or config["keys"], "sort_by": config.get("sort_by") or config.get("timestamp_column") or config["timestamp"], "order": "desc"}, ctx)


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, T.MapType | T.VariantType)


#: run before validation whatever their phase says
PRE_ONLY = ("rename", "select", "drop", "cast", "trim", "lower", "upper", "coalesce", "map_values", "split", "explode", "deduplicate", "deduplicate_by_latest")


def step_of(entry: dict[str, Any]) -> tuple[str, Any, str]:
    """(name, config, phase) of an entry of a contract's transformations."""
    phase = entry.get("phase")
    names = [k for k in entry if k not in ("phase", "description", "name")]
    if len(names) != 1 or names[0] not in TRANSFORMS:
        raise ValueError(f"unknown transform {sorted(names)}; known are {sorted(TRANSFORMS)}")
    name = names[0]
    config = entry[name]
    if isinstance(config, dict) and "phase" in config:
        phase = phase or config["phase"]
        config = {k: v for k, v in config.items() if k != "phase"}
    default = "pre" if name in PRE_ONLY or name == "filter" else "post"
    return name, config, "pre" if name in PRE_ONLY else phase or default


def apply(df: DataFrame, entries: list[dict[str, Any]], ctx: Context, phase: str | None = None) -> DataFrame:
    """The steps of a phase (or all) in order, each exactly once."""
    for entry in entries:
        name, config, own = step_of(entry)
        if phase is None or own == phase:
            df = TRANSFORMS[name](df, config, ctx)
    return df


__all__ = ["Context", "PRE_ONLY", "TRANSFORMS", "apply", "step_of", "text_of"]
