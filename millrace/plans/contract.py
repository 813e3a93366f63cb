"""Contracts: what a pipeline step reads, how rows are reshaped and judged, and how they are stored."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.types import is_numeric, spark_type
from ..operators import dataset_rules as D
from ..operators import rules as R
from ..operators.schema import Field, Policy
from ..operators.transforms import step_of


class ContractError(ValueError):
    """A contract that can't be run as it is written."""


_KEYS = frozenset(
    "name version dataset info domain system layer depends_on source model transformations quality links materialization quarantine schema_policy "
    "lineage masking slo primary_key stages external_logic description owner metadata service_levels upstream downstream server tier extraction "
    "context_files natural_key soft_deletes tags templates compliance notifications ownership".split()
)
#: top-level parts that a run doesn't read, kept as they are
_KEPT = ("metadata", "upstream", "downstream", "server", "tier", "extraction", "context_files", "natural_key", "tags", "templates", "compliance", "notifications", "ownership")


class _Loader(yaml.SafeLoader):
    """YAML in which on, off, yes and no stay text."""


_Loader.yaml_implicit_resolvers = {
    k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def deep_merge(base: Any, over: Any) -> Any:
    """Mappings level by level; lists and values are replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: deep_merge(base[k], v) if k in base else v for k, v in over.items()}
    return over


@dataclass
class Contract:
    name: str
    version: str | None = None
    dataset: str | None = None
    domain: str | None = None
    system: str | None = None
    layer: str | None = None
    owner: str | None = None
    depends_on: list[str] = field(default_factory=list)
    source: dict[str, Any] = field(default_factory=dict)
    fields: list[Field] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    transformations: list[dict[str, Any]] = field(default_factory=list)
    row_rules: list[Any] = field(default_factory=list)
    dataset_rules: list[Any] = field(default_factory=list)
    enforce_required: bool = True
    links: list[dict[str, Any]] = field(default_factory=list)
    materialization: dict[str, Any] = field(default_factory=dict)
    quarantine: dict[str, Any] = field(default_factory=dict)
    policy: Policy = Policy()
    lineage: dict[str, Any] = field(default_factory=dict)
    masking: dict[str, Any] = field(default_factory=dict)
    slo: dict[str, Any] = field(default_factory=dict)
    external_logic: Any = None
    #: parts that a run doesn't read
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def strategy(self) -> str:
        return self.materialization.get("strategy", "overwrite")


def _field(d: dict[str, Any]) -> Field:
    known = {k: d[k] for k in ("name", "type", "required", "min", "max", "max_length", "pii", "masking", "masking_format", "generated") if k in d}
    return Field(**known, accepted_values=tuple(d.get("accepted_values") or ()), extra={k: v for k, v in d.items() if k not in known and k != "accepted_values"})


def load(text: str | dict[str, Any], stage: str | None = None) -> Contract:
    """A contract from YAML text or a mapping; a stage's overrides are merged over it."""
    raw = yaml.load(text, _Loader) if isinstance(text, str) else dict(text)  # noqa: S506 - a safe loader
    if stage and stage in (raw.get("stages") or {}):
        raw = deep_merge({k: v for k, v in raw.items() if k != "stages"}, raw["stages"][stage])
    unknown = sorted(set(raw) - _KEYS)
    if unknown:
        raise ContractError(f"unknown keys: {', '.join(unknown)}")
    info, quality, model, policy = raw.get("info") or {}, raw.get("quality") or {}, raw.get("model") or {}, raw.get("schema_policy") or {}
    fields = [_field(f) for f in model.get("fields") or []]
    metadata = raw.get("metadata") or {}
    upstream = raw.get("upstream") or []
    materialization = dict(raw.get("materialization") or {})
    if (raw.get("soft_deletes") or {}).get("enabled"):
        materialization.setdefault("soft_delete", True)
    c = Contract(
        name=raw.get("name") or info.get("title") or raw.get("dataset") or "contract",
        version=str(raw.get("version") or info.get("version") or "") or None,
        dataset=raw.get("dataset"), domain=raw.get("domain") or metadata.get("domain"), system=raw.get("system") or metadata.get("system"),
        layer=raw.get("layer") or info.get("target_layer") or metadata.get("layer"), owner=raw.get("owner") or info.get("owner") or metadata.get("owner"),
        depends_on=list(raw.get("depends_on") or []) + [u for u in (upstream if isinstance(upstream, list) else [upstream]) if isinstance(u, str)], source=raw.get("source") or {}, fields=fields,
        primary_key=list(raw.get("primary_key") or model.get("primary_key") or []),
        transformations=list(raw.get("transformations") or []), row_rules=list(quality.get("row_rules") or []), dataset_rules=list(quality.get("dataset_rules") or []),
        enforce_required=quality.get("enforce_required", True), links=list(raw.get("links") or []), materialization=materialization,
        quarantine=raw.get("quarantine") or {},
        policy=Policy(policy.get("evolution", "compatible"), policy.get("unknown_fields", "allow"), bool(policy.get("cast_to_string"))),
        lineage=raw.get("lineage") or {}, masking=raw.get("masking") or {}, slo=deep_merge(raw.get("slo") or {}, raw.get("service_levels") or {}), external_logic=raw.get("external_logic"),
        extra={k: raw[k] for k in _KEPT if k in raw},
    )
    for t in c.transformations:
        step_of(t)
    return _govern(c)


def _govern(c: Contract) -> Contract:
    """What a fact type or change data imply."""
    m = c.materialization
    if m.get("fact_type") == "transaction" and c.strategy != "append":
        raise ContractError("a transaction fact is append-only")
    if m.get("fact_type") == "factless" and any(is_numeric(spark_type(f.type) or T.StringType()) and f.name not in c.primary_key and not f.name.endswith(("_key", "_id", "_sk")) for f in c.fields):
        warnings.warn(f"{c.name}: a factless fact has measures", stacklevel=3)
    if c.source.get("load_mode") == "cdc":
        c.materialization = {"strategy": "merge", "soft_delete": True} | m
        c.source = {"watermark_strategy": "pipeline_log"} | c.source
    return c


_NOW = re.compile(r"('(?:[^']|'')*')|\b(current_timestamp|now|current_date)\b(?:\s*\(\s*\))?", re.I)


def pin_instant(c: Contract, at: datetime) -> Contract:
    """The contract with one instant (UTC) for CURRENT_TIMESTAMP, NOW() and CURRENT_DATE in all its SQL."""
    moment = (at.astimezone(timezone.utc) if at.tzinfo else at).strftime("%Y-%m-%d %H:%M:%S.%f")

    def text(m: re.Match) -> str:
        if m[1] or (m[2].lower() == "now" and not m[0].rstrip().endswith(")")):  # a literal, or a column called now
            return m[0]
        return f"DATE '{moment[:10]}'" if m[2].lower() == "current_date" else f"TIMESTAMP '{moment}'"

    def pinned(x: Any) -> Any:
        if isinstance(x, str):
            return _NOW.sub(text, x)
        if isinstance(x, dict):
            return {k: pinned(v) for k, v in x.items()}
        return [pinned(v) for v in x] if isinstance(x, list) else x

    return replace(c, transformations=pinned(c.transformations), row_rules=pinned(c.row_rules), dataset_rules=pinned(c.dataset_rules))


def created_post(c: Contract) -> set[str]:
    """Columns that only a post transform makes."""
    made: set[str] = set()
    for t in c.transformations:
        name, cfg, phase = step_of(t)
        if phase == "post" and isinstance(cfg, dict):
            made |= {cfg[k] for k in ("field", "output") if isinstance(cfg.get(k), str)}
            if name == "join":
                made |= {(cfg.get("prefix") or "") + f for f in cfg.get("fields") or []}
            if name == "rollup":
                made |= set(cfg.get("aggregations") or {})
    return made


def expand_rules(c: Contract, links: dict[str, DataFrame]) -> list[R.Rule]:
    """Row rules of the fields and the contract, generated ones first; each with its phase."""
    out: list[R.Rule] = []
    written: list[R.Rule] = []
    made = created_post(c)

    def phase_of(text: str, given: str | None = None) -> str:
        """A rule without a phase is judged after the post transforms if it reads a column that they make."""
        return given or ("post" if any(re.search(rf"\b{re.escape(m)}\b", text) for m in made) else "pre")

    for item in c.row_rules:
        written += _row_rule(item, links, phase_of)
    said = {r.sql for r in written}
    stamped = {"effective_from", "effective_to", "is_current"} if c.strategy == "scd2" else set()
    if c.materialization.get("fact_type") == "accumulating_snapshot":
        marks = c.materialization.get("milestones") or []
        out += [R.milestone(a, b) for a, b in zip(marks, marks[1:], strict=False)]
    for f in c.fields:
        ph = phase_of(f.name)
        if (f.required or f.name in c.primary_key) and c.enforce_required and f.name not in stamped and f"{f.name} IS NOT NULL" not in said:
            out.append(R.required(f.name, phase=ph))
        if f.accepted_values:
            out.append(R.accepted_values(f.name, f.accepted_values, phase=ph))
        if f.min is not None or f.max is not None:
            out.append(R.in_range(f.name, f.min, f.max, phase=ph))
        if f.max_length:
            out.append(R.max_length(f.name, f.max_length, phase=ph))
    for t in c.transformations:
        name, cfg, _ = step_of(t)
        if name.startswith("deduplicate") and cfg.get("blank_keys", "quarantine") == "quarantine":
            keys = [cfg["on"]] if isinstance(cfg["on"], str) else list(cfg["on"])
            if not all(f"{k} IS NOT NULL" in said | {r.sql for r in out} for k in keys):
                out.append(R.dedup_keys_present(keys))
    return out + written


def _row_rule(item: Any, links: dict[str, DataFrame], phase_of: Callable[..., str]) -> list[R.Rule]:
    if not isinstance(item, dict):
        raise ContractError(f"not a rule: {item!r}")
    if "sql" in item:
        return [R.custom(item["name"], item["sql"], item.get("category", "correctness"), item.get("severity", "error"), phase_of(item["sql"], item.get("phase")))]
    (kind, cfg), *_ = [(k, v) for k, v in item.items() if k not in ("phase", "name", "severity", "category")]
    ph = lambda f: phase_of(f, item.get("phase"))
    if kind == "not_null":
        names = cfg if isinstance(cfg, list) else [cfg] if isinstance(cfg, str) else cfg.get("fields") or [cfg["field"]]
        return [R.not_null(n, phase=ph(n)) for n in names]
    name = cfg.get("name") or item.get("name")
    if kind == "accepted_values":
        return [R.accepted_values(cfg["field"], cfg["values"], name=name, phase=ph(cfg["field"]))]
    if kind == "regex_match":
        return [R.regex_match(cfg["field"], cfg["pattern"], name=name, phase=ph(cfg["field"]))]
    if kind == "range":
        return [R.in_range(cfg["field"], cfg.get("min"), cfg.get("max"), cfg.get("inclusive", True), name=name, phase=ph(cfg["field"]))]
    if kind == "referential_integrity":
        if not (cfg.get("field") and cfg.get("reference") and cfg.get("key")):
            return []
        return [R.referential_integrity(cfg["field"], links[cfg["reference"]], cfg["key"], name, phase=ph(cfg["field"]))]
    if kind == "lifecycle_window":
        return [R.lifecycle_window(cfg["event_ts"], cfg["event_key"], links[cfg["reference"]], cfg["reference_key"], cfg["start_field"], cfg["end_field"], name, phase=ph(cfg["event_ts"]))]
    raise ContractError(f"unknown row rule: {kind}")


def expand_dataset_rules(c: Contract) -> list[D.DatasetRule]:
    out = [_dataset_rule(i) for i in c.dataset_rules]
    if c.primary_key and c.strategy != "scd2" and "_".join(c.primary_key) + "_unique" not in {r.name for r in out}:
        out.append(D.unique(c.primary_key))
    return out


def _dataset_rule(item: dict[str, Any]) -> D.DatasetRule:
    scope = item.get("quarantine_scope") or ()
    scope = (scope,) if isinstance(scope, str) else tuple(scope)
    if "sql" in item:
        between = item.get("must_be_between")
        return D.statement(item["name"], item["sql"], less_than=item.get("must_be_less_than"), greater_than=item.get("must_be_greater_than"), between=tuple(between) if between else None, scope=scope)
    (kind, cfg), *_ = [(k, v) for k, v in item.items() if k not in ("name", "quarantine_scope")]
    name = item.get("name") or (cfg.get("name") if isinstance(cfg, dict) else None)
    if kind == "unique":
        keys = cfg if isinstance(cfg, str | list) else cfg.get("fields") or cfg["field"]
        return D.unique(keys, name=name, scope=scope)
    if kind == "null_ratio":
        return D.null_ratio(cfg["field"], cfg["max"], name=name, scope=scope)
    if kind == "row_count_between":
        return D.row_count_between(cfg.get("min"), cfg.get("max"), name=name, scope=scope)
    raise ContractError(f"unknown dataset rule: {kind}")
