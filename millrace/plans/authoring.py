"""Tools around contracts: lint, gates between versions, DDL, inference, import and export."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col
from ..functions.types import can_widen, spark_type
from ..operators.profile import pii_by_name, profile
from ..operators.schema import Field
from ..operators.transforms import TRANSFORMS, step_of
from .contract import Contract, ContractError, load


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    message: str


KEYED, ENTITY_LAYERS = ("merge", "scd1", "scd2", "upsert"), ("silver", "gold")


def lint(source: str | dict[str, Any]) -> list[Finding]:
    """Faults of a contract that can be seen without data: critical, warning or info."""
    try:
        c = load(source)
    except ContractError as e:
        return [Finding("PARSE-000", "critical", str(e))]
    except ValueError as e:
        return [Finding("TRF-001", "critical", str(e))]
    except Exception as e:  # noqa: BLE001 - text that is no YAML
        return [Finding("PARSE-000", "critical", f"not readable: {e}")]
    out: list[Finding] = []

    def found(code: str, severity: str, message: str, when: bool = True) -> None:
        if when:
            out.append(Finding(code, severity, message))

    m, key = c.materialization, c.primary_key or c.materialization.get("primary_key")
    steps = [step_of(t) for t in c.transformations]
    dedups = [(name, cfg) for name, cfg, _ in steps if name.startswith("deduplicate")]
    names = lambda x: [x] if isinstance(x, str) else list(x or [])
    # keys and order
    unkeyed = not key and not any(names(cfg.get("on") or cfg.get("key_columns")) for _, cfg in dedups)
    found("PK-002", "critical", f"{c.strategy} or a deduplication needs a key, and none is declared", unkeyed and (c.strategy in KEYED or bool(dedups)))
    for name, cfg in dedups:
        order = names(cfg.get("sort_by")) if name == "deduplicate" else names(cfg.get("timestamp_column") or cfg.get("sort_by"))
        found("KEY-001", "critical", "a deduplication without an order keeps any of its rows", not order)
        inside = bool(order) and name == "deduplicate" and {o.lower() for o in order} <= {k.lower() for k in names(cfg.get("on"))}
        found("KEY-002", "critical", "a deduplication ordered by its own key orders nothing", inside)
    found("KEY-003", "info", "natural_key is not read; the business key is primary_key", bool(c.extra.get("natural_key")))
    # personal and sensitive fields
    for n in pii_by_name([f.name for f in c.fields if not f.pii]):
        found("PII-001", "warning", f"{n} looks personal but is not marked")
    for f in c.fields:
        bare = not f.masking and not f.extra.get("security_groups")
        found("PII-002", "warning", f"{f.name} is personal but has no masking", bool(f.pii) and bare)
        found("SENS-001", "warning", f"{f.name} is sensitive but has no masking", bool(f.extra.get("sensitive")) and bare)
    # what is kept of rows that are deleted at the source
    entity = c.layer in ENTITY_LAYERS and not unkeyed and (c.strategy in KEYED or bool(dedups))
    deletes = any(m.get(k) for k in ("soft_delete", "soft_delete_column", "cdc_delete_values", "cdc_op_field", "deletion", "snapshot")) or c.source.get("load_mode") == "cdc"
    found("DEL-001", "warning", "rows that are deleted at the source stay: no delete strategy", entity and not deletes)
    ruled = bool(c.row_rules or c.dataset_rules) or any(f.required or f.accepted_values or f.min is not None or f.max is not None or f.extra.get("rules") for f in c.fields)
    found("QLT-001", "warning", "a silver table without any quality rule", c.layer == "silver" and not ruled)
    tracked = m.get("track_columns") or (m.get("scd2") or {}).get("track_columns")
    found("SCD-001", "critical", "scd2 without track_columns makes a version at every load", c.strategy == "scd2" and not tracked)
    # source, service levels, streams
    found("SRC-001", "warning", "a bronze landing source without partitions is scanned whole at every load", c.layer == "bronze" and c.source.get("type") == "landing" and not c.source.get("partition"))
    found("VOL-001", "info", "no freshness or row count is promised", c.layer in ENTITY_LAYERS and not (c.slo.get("freshness") or c.slo.get("row_count")))
    trigger = c.source.get("trigger")
    resumable = c.source.get("type") == "stream" or trigger in ("continuous", "available_now") or bool(c.source.get("resumable"))
    found("STREAM-001", "warning", "a batch that is delivered again is appended again", resumable and c.strategy == "append")
    found("STREAM-002", "info", "a continuous trigger keeps a cluster running", trigger == "continuous")
    made = {cfg["field"] for _, cfg, phase in steps if phase == "post" and isinstance(cfg, dict) and isinstance(cfg.get("field"), str)}
    for r in c.row_rules:
        early = isinstance(r, dict) and r.get("phase") == "pre" and any(re.search(rf"\b{re.escape(x)}\b", str(r)) for x in made)
        found("PHS-001", "critical", f"a pre rule reads a column that is made later: {r.get('name') if isinstance(r, dict) else r}", early)
    # people
    owners = c.extra.get("ownership") or {}
    for role, who in owners.items():
        found("OWN-001", "warning", f"{role} is one person without a group", isinstance(who, dict) and bool(who.get("person") or who.get("email")) and not who.get("group"))
    answers = any(isinstance(w, dict) and "blocking_questions" in (w.get("accountable_for") or []) for w in owners.values())
    found("OWN-002", "warning", "nobody is accountable for blocking questions", bool(owners) and not answers)
    return out


# -- gates between versions -------------------------------------------------
def breaking_changes(old: Contract, new: Contract) -> list[str]:
    now = {f.name: f for f in new.fields}
    out = []
    for f in old.fields:
        if f.name not in now:
            out.append(f"field removed: {f.name}")
        elif spark_type(f.type) != spark_type(now[f.name].type):
            safe = spark_type(f.type) is not None and spark_type(now[f.name].type) is not None and can_widen(spark_type(f.type), spark_type(now[f.name].type))
            out += [] if safe else [f"type changed: {f.name} {f.type} -> {now[f.name].type}"]
    return out


def unclassified_pii(c: Contract) -> list[str]:
    return pii_by_name([f.name for f in c.fields if not f.pii])


def broken_lineage(contracts: list[Contract]) -> list[str]:
    known = {c.name for c in contracts} | {c.dataset for c in contracts if c.dataset}
    return [f"{c.name}: depends on unknown {d}" for c in contracts for d in c.depends_on if d not in known]


# -- DDL --------------------------------------------------------------------
_DIALECTS: dict[str, dict[str, str]] = {
    "postgres": {"string": "TEXT", "tinyint": "SMALLINT", "double": "DOUBLE PRECISION", "float": "REAL", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP", "binary": "BYTEA"},
    "duckdb": {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "binary": "BLOB"},
    "bigquery": {"string": "STRING", "tinyint": "INT64", "smallint": "INT64", "int": "INT64", "bigint": "INT64", "double": "FLOAT64", "float": "FLOAT64", "boolean": "BOOL", "timestamp_ntz": "DATETIME", "binary": "BYTES"},
    "snowflake": {"string": "VARCHAR", "double": "DOUBLE", "timestamp": "TIMESTAMP_TZ", "timestamp_ntz": "TIMESTAMP_NTZ"},
    "mysql": {"string": "TEXT", "timestamp": "DATETIME(6)", "timestamp_ntz": "DATETIME(6)", "binary": "BLOB", "boolean": "BOOLEAN"},
    "sqlserver": {"string": "NVARCHAR(MAX)", "double": "FLOAT(53)", "float": "REAL", "boolean": "BIT", "timestamp": "DATETIMEOFFSET", "timestamp_ntz": "DATETIME2", "binary": "VARBINARY(MAX)"},
}


def create_table(table: str, fields: list[Field], dialect: str = "spark", partition_by: list[str] = (), primary_key: list[str] = ()) -> str:
    """CREATE TABLE in a dialect; personal fields say so in a comment."""
    lines = []
    for f in fields:
        kind = spark_type(f.type) or T.StringType()
        name = kind.simpleString()
        text = name.upper() if dialect == "spark" else _DIALECTS[dialect].get(name, name.upper())
        comment = " COMMENT 'PII'" if f.pii and dialect in ("spark", "snowflake", "mysql") else ""
        lines.append(f"  {f.name} {text}{' NOT NULL' if f.required or f.name in primary_key else ''}{comment}")
    if primary_key and dialect not in ("spark", "bigquery"):
        lines.append(f"  PRIMARY KEY ({', '.join(primary_key)})")
    tail = ""
    if dialect == "spark":
        tail = " USING parquet" + (f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else "")
    return f"CREATE TABLE IF NOT EXISTS {table} (\n" + ",\n".join(lines) + f"\n){tail}"


def alter_table(table: str, old: list[Field], new: list[Field]) -> list[str]:
    """Statements for added fields and safe widenings; anything else is refused."""
    have, out = {f.name: f for f in old}, []
    for f in new:
        kind = spark_type(f.type) or T.StringType()
        if f.name not in have:
            out.append(f"ALTER TABLE {table} ADD COLUMNS ({f.name} {kind.simpleString().upper()})")
            continue
        before = spark_type(have[f.name].type) or T.StringType()
        if before != kind:
            if not can_widen(before, kind):
                raise ContractError(f"{f.name}: {before.simpleString()} can't become {kind.simpleString()} in place")
            out.append(f"ALTER TABLE {table} ALTER COLUMN {f.name} TYPE {kind.simpleString().upper()}")
    return out


# -- inference --------------------------------------------------------------
def infer(df: DataFrame, name: str, max_accepted: int = 20) -> dict[str, Any]:
    """A draft contract from data: types, required and unique fields, accepted values, ranges, personal fields."""
    stats = {r["column"]: r for r in profile(df, exact=True).collect()}  # one row per column
    small = [c for c, r in stats.items() if isinstance(df.schema[c].dataType, T.StringType) and r["distinct"] and r["distinct"] <= max_accepted and r["distinct"] < 0.5 * r["rows"]]
    values: dict[str, list] = {}
    if small:
        row = df.agg(*[F.array_sort(F.collect_set(col(c))).alias(c) for c in small]).first()  # at most max_accepted each
        values = {c: list(row[c]) for c in small}
    personal = set(pii_by_name(df.columns))
    fields, unique = [], []
    for f in df.schema:
        r = stats[f.name]
        d: dict[str, Any] = {"name": f.name, "type": f.dataType.simpleString()}
        if r["rows"] and r["non_null"] == r["rows"]:
            d["required"] = True
            if r["distinct"] == r["rows"] and not isinstance(f.dataType, T.DoubleType | T.FloatType | T.TimestampType | T.TimestampNTZType | T.DateType):
                unique.append(f.name)
        if f.name in values:
            d["accepted_values"] = values[f.name]
        elif isinstance(f.dataType, T.NumericType) and f.name not in unique and r["min"] is not None:
            low = float(r["min"])
            if low >= 0:
                d["min"] = 0
        if f.name in personal:
            d |= {"pii": True, "masking": "partial"}
        fields.append(d)
    out: dict[str, Any] = {"name": name, "model": {"fields": fields}, "quality": {"dataset_rules": [{"unique": u} for u in unique]}}
    if unique:
        out["primary_key"] = unique[:1]
    return out


def from_dbt(model: dict[str, Any]) -> dict[str, Any]:
    """A contract from a dbt model's columns and tests."""
    fields, rows, data = [], [], []
    for c in model.get("columns") or []:
        d: dict[str, Any] = {"name": c["name"], "type": c.get("data_type", "string")}
        for test in c.get("data_tests") or c.get("tests") or []:
            if test == "not_null":
                d["required"] = True
            elif test == "unique":
                data.append({"unique": c["name"]})
            elif isinstance(test, dict) and "accepted_values" in test:
                d["accepted_values"] = test["accepted_values"]["values"]
            elif isinstance(test, dict) and "relationships" in test:
                to = test["relationships"]
                rows.append({"referential_integrity": {"field": c["name"], "reference": str(to["to"]).removeprefix("ref('").removesuffix("')"), "key": to["field"]}})
        fields.append(d)
    return {"name": model["name"], "description": model.get("description", ""), "model": {"fields": fields}, "quality": {"row_rules": rows, "dataset_rules": data}}


def to_odcs(c: Contract) -> dict[str, Any]:
    """The contract as an Open Data Contract Standard v3 document."""
    props = []
    for f in c.fields:
        p: dict[str, Any] = {"name": f.name, "logicalType": f.type or "string", "required": f.required}
        if f.name in c.primary_key:
            p |= {"primaryKey": True, "primaryKeyPosition": c.primary_key.index(f.name) + 1}
        if f.pii:
            p["classification"] = "restricted"
        props.append(p)
    return {"apiVersion": "v3.0.0", "kind": "DataContract", "id": c.name, "version": c.version or "1.0.0", "status": "active", "schema": [{"name": c.dataset or c.name, "logicalType": "object", "properties": props}]}


def from_odcs(doc: dict[str, Any]) -> dict[str, Any]:
    table = doc["schema"][0]
    keys = sorted((p for p in table.get("properties", []) if p.get("primaryKey")), key=lambda p: p.get("primaryKeyPosition", 0))
    fields = [{"name": p["name"], "type": p.get("logicalType", "string"), "required": bool(p.get("required")), "pii": p.get("classification") == "restricted"} for p in table.get("properties", [])]
    return {"name": doc["id"], "version": doc.get("version"), "dataset": table["name"], "primary_key": [k["name"] for k in keys], "model": {"fields": fields}}


def known_transforms() -> list[str]:
    return sorted(TRANSFORMS)
