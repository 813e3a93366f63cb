"""Column expressions that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_nested, spark_type


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; nested values as JSON."""
    return F.to_json(col(name)) if is_nested(df.schema[name].dataType) else col(name).cast("string")


def try_cast(value: Column, kind: T.DataType | str) -> Column:
    wanted = spark_type(kind) if isinstance(kind, str) else kind
    return value if wanted is None else value.try_cast(wanted)


def as_date(value: Column) -> Column:
    """A date from a date, a timestamp, or text as yyyy-MM-dd... or yyyyMMdd."""
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")), text.try_cast("date"))


def as_timestamp(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))), text.try_cast("timestamp"))


def json_path(path: str) -> str:
    """A path whose quoted keys (``$."my key"``) are in the bracket form that Spark reads."""
    return re.sub(r'\.?"([^"]+)"', lambda m: f"['{m[1]}']", path)


def literal(value) -> Column:
    return F.lit(value)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def surrogate_key(keys: list[str]) -> Column:
    """16 hex digits of the SHA-256 of the key, null parts as an empty string."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]), 256), 1, 16)


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][\w$]*|\s+|.", re.S)


def bind(sql: str, frames: dict[str, DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """SQL with each frame's name, where it stands for a table, as a parameter of ``spark.sql``.

    Names inside quotes and comments, and names after or before a dot, are left alone;
    a name counts as a table after FROM, JOIN or a comma of a FROM list.
    """
    parts = _TOKEN.findall(sql)
    out, used = [], {}
    lowered = {n.lower(): n for n in frames}
    expect = False
    in_from = False
    for i, p in enumerate(parts):
        low = p.lower()
        bare = low.strip("`")
        if p[0] in "'\"" or p.startswith(("--", "/*")) or p.isspace():
            out.append(p.replace("{", "{{").replace("}", "}}"))
            continue
        nxt = next((x for x in parts[i + 1 :] if not x.isspace()), "")
        if expect and bare in lowered and nxt != ".":
            name = lowered[bare]
            arg = "t_" + re.sub(r"\W", "_", name)
            used[arg] = frames[name]
            after = [x.lower() for x in parts[i + 1 :] if not x.isspace()][:2]
            aliased = bool(after) and (after[0] == "as" or (re.fullmatch(r"[a-z_]\w*|`.*`", after[0]) is not None and after[0] not in _AFTER_TABLE))
            out.append("{" + arg + "}" + ("" if aliased else f" AS `{name}`"))
        else:
            out.append(p.replace("{", "{{").replace("}", "}}"))
        if low in ("from", "join"):
            expect, in_from = True, low == "from" or in_from
        elif p == "," and in_from:
            expect = True
        else:
            expect = False
            if low in ("where", "group", "order", "having", "limit", "union", "select", ")", "on", "window"):
                in_from = False
    return "".join(out), used


_AFTER_TABLE = frozenset(
    "where group order having limit union intersect except join inner left right full cross on natural lateral window tablesample pivot unpivot anti semi using minus".split()
)


def run_sql(df: DataFrame, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A statement over the current frame (``source``) and named frames, without temporary views."""
    text, used = bind(sql, frames)
    return df.sparkSession.sql(text, **used)


def small_enough(df: DataFrame, rows: int, size: int) -> bool:
    """No more than ``rows`` rows and ``size`` bytes (as text), measured no further than the bound of rows."""
    n = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*[col(c) for c in df.columns])))), F.lit(0)).alias("size")).first()
    return n["n"] <= rows and n["size"] <= size
