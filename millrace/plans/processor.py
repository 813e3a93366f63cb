"""Running a contract: frame in, good and bad rows out.

Order: external logic, pre transforms, schema, pre rules, split, post transforms, post
rules, dataset rules (on the good rows), lineage, masking.  Everything up to the
dataset rules is one lazy plan.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import run_sql, small_enough
from ..operators import dataset_rules as D
from ..operators import governance as G
from ..operators import merge as M
from ..operators import rules as R
from ..operators import schema as S
from ..operators import scd2 as V
from ..operators import slo as O
from ..operators import transforms as T
from ..sources import files, incremental, sinks
from . import notify as N
from .contract import Contract, ContractError, created_post, expand_dataset_rules, expand_rules, load, pin_instant


class DatasetRuleFailed(RuntimeError):
    """A dataset rule failed and the contract says stop."""


class QuarantineNotAllowed(RuntimeError):
    """Rows were rejected and the contract allows none."""


@dataclass
class Result:
    good: DataFrame
    bad: DataFrame
    dataset_results: list[D.DatasetResult] = field(default_factory=list)
    run: G.RunInfo | None = None
    source: DataFrame | None = None
    #: the frame that good and bad are two filters of, where that is all they are
    evaluated: DataFrame | None = None

    def __iter__(self):
        return iter((self.good, self.bad))

    def __getitem__(self, i: int) -> DataFrame:
        return (self.good, self.bad)[i]

    def counts(self) -> dict[str, int]:
        """Rows of source, good and quarantined; good and bad by one aggregate where one frame holds both."""
        source = self.source.count() if self.source is not None else 0
        if self.evaluated is not None:
            n = self.evaluated.agg(F.count("*").alias("n"), F.count_if(F.size(R.ERRORS) > 0).alias("bad")).first()
            return G.reconcile_counts(source, n["n"] - n["bad"], n["bad"])
        return G.reconcile_counts(source, self.good.count(), self.bad.count())


class Processor:
    """A contract with its links, ready to run on frames or on its own source."""

    def __init__(self, contract: Contract | str | dict, spark: SparkSession, links: dict[str, DataFrame] | None = None, stage: str | None = None, external: Callable | None = None):
        self.contract = contract if isinstance(contract, Contract) else load(contract, stage)
        self.spark, self.external = spark, external
        self.links = dict(links or {})
        small = set()
        for link in self.contract.links:
            if link["name"] not in self.links:
                cfg = files.SourceConfig(link.get("path", ""), link.get("format", "parquet"), link.get("table"))
                self.links[link["name"]] = files.read(spark, cfg)
            df = self.links[link["name"]]
            if link.get("filter"):
                df = df.filter(F.expr(link["filter"]))
            if link.get("query"):
                df = run_sql(df, link["query"].replace("{link}", link["name"]), {link["name"]: df})
            if link.get("columns"):
                df = df.select(*link["columns"])
            self.links[link["name"]] = df
            if link.get("broadcast") and self._small(df):
                small.add(link["name"])
        self.context = T.Context(self.links, small, self.contract.dataset)

    @staticmethod
    def _small(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> bool:
        """Few enough rows and bytes to broadcast, measured no further than the bound."""
        return small_enough(df, rows, size)

    # -- frame in, frames out ------------------------------------------------
    def run(self, df: DataFrame, run_id: str | None = None, source: str = "", at: datetime | None = None, user_groups: set[str] = frozenset()) -> Result:
        at = at or datetime.now(timezone.utc)
        c = pin_instant(self.contract, at)
        info = G.RunInfo(run_id or uuid.uuid4().hex, c.name, c.version, source, c.domain, c.system, at=at)
        raw = df
        if self.external is not None:
            made = self.external(df, contract=c, engine="spark", **(c.external_logic or {}).get("args", {}))
            df = self.spark.read.parquet(made) if isinstance(made, str) else df if made is None else made
        df = T.apply(df, c.transformations, self.context, "pre")
        df, errors = S.enforce(df, [f for f in c.fields if f.name in df.columns or not self._made_later(f.name)], c.policy)
        rules = expand_rules(c, self.links)
        evaluated = R.evaluate(df, [r for r in rules if r.phase == "pre"], errors)
        evaluated = evaluated.drop(*[x for x in evaluated.columns if x.startswith("__bad_")])
        good, bad = R.split(evaluated)
        pre_good = good
        good = T.apply(good, c.transformations, self.context, "post")
        post = [r for r in rules if r.phase == "post"]
        if post:
            good, late = R.split(R.evaluate(good, post))
            bad = bad.unionByName(late, allowMissingColumns=True)
        one_frame = good is pre_good and not post
        good, bad, results = self._dataset_rules(good, bad, c)
        one_frame = one_frame and (c.quarantine.get("on_dataset_failure", "continue") != "quarantine" or all(x.passed is not False for x in results))
        for name, value in (c.lineage.get("add_columns") or {}).items():  # constants of the contract
            good, bad = good.withColumn(name, F.lit(value)), bad.withColumn(name, F.lit(value))
        if c.lineage.get("enabled", True):
            flags = c.lineage.get("columns")
            good = G.lineage(good, info, flags, c.lineage.get("upstream_prefix"))
            bad = G.lineage(bad, info, flags, c.lineage.get("upstream_prefix"))
        masks = [G.Masked(f.name, f.masking, f.masking_format) for f in c.fields if f.pii and f.masking]
        if masks:
            how = {"salt": c.masking.get("salt", ""), "key": c.masking.get("key"), "user_groups": user_groups, "allowed_groups": set(c.masking.get("security_groups") or ())}
            good, bad = G.apply_masks(good, masks, **how), G.apply_masks(bad, masks, **how)
        if c.quarantine.get("enabled", True) is False or c.quarantine.get("fail_on_quarantine"):
            if not bad.isEmpty():
                raise QuarantineNotAllowed(f"{c.name}: rows were rejected")
        if not c.quarantine.get("include_error_reason", True):
            bad = bad.drop(R.ERRORS, R.CATEGORIES)
        return Result(good, bad, results, info, raw, evaluated if one_frame else None)

    def _made_later(self, name: str) -> bool:
        return name in created_post(self.contract)

    def _dataset_rules(self, good: DataFrame, bad: DataFrame, c: Contract) -> tuple[DataFrame, DataFrame, list[D.DatasetResult]]:
        rules = expand_dataset_rules(c)
        if not rules:
            return good, bad, []
        results = D.check(good, rules, self.links)
        failed = [r for r, x in zip(rules, results, strict=True) if x.passed is False]
        policy = c.quarantine.get("on_dataset_failure", "continue")
        if not failed or policy == "continue":
            return good, bad, results
        if policy == "stop":
            raise DatasetRuleFailed(f"{c.name}: {', '.join(r.name for r in failed)}")
        for rule in failed:
            tag = {R.ERRORS: F.array(F.lit(f"Dataset rule failed: {rule.name}")), R.CATEGORIES: F.array(F.lit("dataset")), R.STATE: F.lit("active"), R.REPROCESSED: F.lit(False)}
            if rule.scope:
                if rule.agg is None:
                    raise ContractError(f"{rule.name}: a scoped rule must be one aggregate of the source")
                good, out = D.split_by_scope(good, rule)
            else:
                good, out = good.limit(0), good
            bad = bad.unionByName(out.withColumns(tag), allowMissingColumns=True)
        return good, bad, results

    # -- source in, table out ------------------------------------------------
    def read(self, now: datetime | None = None, target: DataFrame | None = None, runs: DataFrame | None = None, **window: Any) -> DataFrame:
        """The contract's source, from where the last run stopped."""
        s = self.contract.source
        df = files.read(self.spark, files.source_config(s, self.contract.fields))
        if window.get("reprocess_values") is not None:
            return files.reprocess(df, window["reprocess_column"], values=window["reprocess_values"])
        boundary = incremental.resolve(s | {"dataset": self.contract.dataset}, now or datetime.now(), target, runs, **window)
        return boundary.apply(df) if boundary else df

    def materialize(self, good: DataFrame, table: sinks.SnapshotTable, now: Any = None) -> int:
        """Good rows into their table by the contract's strategy."""
        c, m = self.contract, self.contract.materialization
        keys = list(m.get("primary_key") or c.primary_key)
        if c.strategy in ("merge", "scd1", "scd2") and not keys:
            raise ContractError(f"{c.strategy} needs a primary key")
        soft = M.SoftDelete(timestamp_field=m.get("cdc_timestamp_field")) if m.get("soft_delete") else None

        def step(old: DataFrame | None) -> DataFrame:
            new = good
            if c.strategy == "scd2":
                cfg = V.Scd2(tuple(keys), m["change_date"], tuple(m.get("track_columns") or ()))
                out = V.apply(old.filter(F.col("_sk") != "-1") if old is not None else None, new, cfg)
                return M.unknown_member(out, keys) if m.get("unknown_member") else out
            if c.strategy == "scd1":
                new = M.with_surrogate_key(new, keys)
            if old is None:
                if m.get("cdc_op_field"):
                    new = new.filter(~F.coalesce(F.col(m["cdc_op_field"]).isin(m.get("cdc_delete_values", ["delete"])), F.lit(False))).drop(m["cdc_op_field"])
                out = M.last_per_key(new, keys, m["sort_by"]) if keys and m.get("sort_by") else new
            elif m.get("snapshot"):
                out = M.reconcile(old, new, keys, soft, F.expr(m["scope"]) if m.get("scope") else None, m.get("max_delete_ratio"), now)
            elif m.get("cdc_op_field"):
                out = M.apply_changes(old, new, keys, m["cdc_op_field"], m.get("cdc_delete_values", ["delete"]), soft, m.get("sort_by"), now)
            else:
                if m.get("sort_by"):
                    new = M.last_per_key(new, keys, m["sort_by"])
                a, b = sinks.align(old, new, m.get("strict", False))
                out = M.upsert(a, b, keys, ("_dc_created_at",))
            return M.unknown_member(out, keys) if m.get("unknown_member") and c.strategy == "scd1" else out

        if c.strategy == "append":
            return table.append(good, m.get("batch_key"))
        if c.strategy == "overwrite":
            return table.write(good)
        # rows of a key stay in their partition where the key holds it: then only touched partitions are merged
        scoped = table.partition_by and (set(table.partition_by) <= set(keys) or m.get("partition_scoped"))
        if scoped and c.strategy in ("merge", "scd1") and not m.get("snapshot") and not m.get("unknown_member"):
            return table.merge_partitions(good, lambda old, _: step(old))
        return table.change(step)

    def reprocess(self, good: DataFrame, table: sinks.SnapshotTable) -> int:
        """Rows of a reprocessed range into their table, by the contract's ``reprocess_policy``.

        ``overwrite_partition`` replaces the partitions that the rows are in, ``overwrite_partition_safe`` too but
        never by fewer rows than are there, ``overwrite_all`` the whole table; ``append`` adds; ``merge`` goes by
        the primary key; ``fail`` refuses.
        """
        m = self.contract.materialization
        policy = m.get("reprocess_policy", "overwrite_partition")
        match policy:
            case "fail":
                raise ContractError(f"{self.contract.name}: reprocessing is not allowed")
            case "append":
                return table.append(good)
            case "overwrite_all":
                return table.write(good)
            case "merge":
                keys = list(m.get("primary_key") or self.contract.primary_key)
                if not keys:
                    raise ContractError("merge needs a primary key")
                return table.change(lambda old: good if old is None else M.upsert(*sinks.align(old, good), keys))
            case "overwrite_partition" | "overwrite_partition_safe":
                if not table.partition_by:
                    raise ContractError(f"{policy} needs a partitioned table")

                def put(old: DataFrame | None, new: DataFrame) -> DataFrame:
                    if policy.endswith("_safe") and old is not None and new.count() < old.count():
                        raise ContractError(f"{self.contract.name}: fewer rows than the partitions hold")
                    return new

                return table.merge_partitions(good, put)
        raise ContractError(f"unknown reprocess policy: {policy}")

    def service_levels(self, table: sinks.SnapshotTable, counts: dict[str, int], log: sinks.RunLog | None = None, now: datetime | None = None) -> dict[str, bool | None]:
        """What the contract promises of its data, each kept, broken or (None) not to be told."""
        s, at, out = self.contract.slo, now or datetime.now(), {}
        df = table.read()
        seconds = lambda c: O.seconds_of(c.get("threshold") or c.get("max_age") or "P1D")
        if (c := s.get("freshness")) and c.get("field") and df is not None:
            out["freshness"] = O.freshness(df, c["field"], seconds(c), F.lit(at)).first()["passed"]
        if (c := s.get("availability")) and c.get("field") and df is not None:
            out["availability"] = O.availability(df, c["field"], float(c.get("threshold", 100))).first()["passed"]
        if (c := s.get("retention")) and c.get("field") and c.get("period") and df is not None:
            out["retention"] = O.retention(df, c["field"], c["period"], F.lit(at)).first()["passed"]
        if c := s.get("row_count"):
            n = counts["good"]
            out["row_count"] = n >= c.get("min_rows", 0) and (c.get("max_rows") is None or n <= c["max_rows"])
            if log is not None and c.get("method"):
                runs = log.read().filter("status = 'success' AND stage = 'run'")
                verdict = O.row_count_anomaly(runs, n, at, self.contract.dataset or self.contract.name, method=c["method"], min_runs=int(c.get("min_runs_before_enforcement", 5))).first()["verdict"]
                out["row_count_anomaly"] = None if verdict == "insufficient_history" else verdict == "normal"
        return out

    def run_all(self, table: sinks.SnapshotTable, quarantine_path: str | None = None, log: sinks.RunLog | None = None, **window: Any) -> dict[str, int]:
        """Read, run, store, quarantine, and write the run down."""
        began, c = time.time(), self.contract
        df = self.read(target=table.read(), runs=log.read() if log else None, **window)
        stage = "reprocess" if window else "run"
        if df.isEmpty():
            if c.source.get("on_empty", "skip") == "fail":
                raise RuntimeError(f"{c.name}: its source is empty")
            if log:
                log.add(run_id=uuid.uuid4().hex, dataset=c.dataset or c.name, stage="no_new_data", status="success", timestamp=datetime.now())
            return {"source": 0, "good": 0, "quarantined": 0}
        result = self.run(df, source=str(c.source.get("path") or c.source.get("table") or ""))
        counts = result.counts()
        gate = O.quality_gate(counts["good"], counts["quarantined"], (c.slo.get("quality") or {}).get("min_good_ratio"), (c.slo.get("quality") or {}).get("max_quarantine_ratio"))
        reprocessed = any(window.get(k) is not None for k in ("reprocess_from", "reprocess_to", "reprocess_values"))
        self.reprocess(result.good, table) if reprocessed and self.contract.strategy == "append" and "reprocess_policy" in c.materialization else self.materialize(result.good, table)
        m = c.materialization
        if m.get("secondary"):  # the same rows to further targets
            sinks.secondary(result.good, m["secondary"])
        if m.get("compact_files") and len(table.parts(table.version) or []) > int(m.get("compact_after", 20)):
            table.compact(int(m["compact_files"]))
        levels = self.service_levels(table, counts, log)
        broken = sorted(k for k, ok in levels.items() if ok is False)
        targets = N.targets_of(c.extra.get("notifications"))
        faults = [f for event, text in N.events_of(counts, result.dataset_results, broken) for f in N.notify(targets, event, c.name, text)]
        if quarantine_path and counts["quarantined"]:
            sinks.quarantine(result.bad).write.mode("append").option("mergeSchema", True).parquet(quarantine_path)
        if log:
            log.add(
                run_id=result.run.run_id, dataset=c.dataset or c.name, stage=stage, status="success", timestamp=datetime.now(), duration_s=time.time() - began,
                counts_source=counts["source"], counts_good=counts["good"], counts_quarantined=counts["quarantined"], counts_dropped=counts["pre_transform_dropped"], quality_gate=gate,
                message="; ".join([f"service level broken: {k}" for k in broken] + faults) or None,
            )
        return counts
