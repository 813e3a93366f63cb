"""Requests to erase people, worked off against frames, with evidence of what was done.

Requests and evidence are snapshot tables.  Subjects are joined, never listed in a plan, and never shown.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..functions.masking import mask
from ..sources.sinks import SnapshotTable
from .governance import Masked

# fixed values: columns of the two tables, and the states of a request
REQUESTS = (
    "request_id string, framework string, subject_column string, subject_id string, requested_at timestamp, requested_by string, reason string, status string, "
    "processed_at timestamp, run_id string, system string"
)
EVIDENCE = (
    "run_id string, timestamp timestamp, profile string, dataset string, table_name string, subject_count bigint, rows_affected bigint, reason string, status string, "
    "contract string, contract_version string, domain string, system string"
)
FRAMEWORKS = ("gdpr", "hipaa")
STATUSES = ("pending", "completed", "failed", "dry_run")
#: states that a run picks up; a rehearsal doesn't use a request up
OPEN = ("pending", "dry_run")


def open_requests(requests: DataFrame, frameworks: tuple[str, ...] = FRAMEWORKS, system: str | None = None) -> DataFrame:
    """Requests that wait; with a system, those of it and those of none."""
    hit = col("status").isin(*OPEN) & F.lower("framework").isin(*frameworks)
    if system is not None:
        hit = hit & (col("system").isNull() | (col("system") == system))
    return requests.filter(hit)


def erase_requested(df: DataFrame, requests: DataFrame, subject: str, masks: list[Masked], at: Column | None = None, salt: str = "", reason: str = "erasure_request") -> DataFrame:
    """``df`` with the fields of requested subjects masked and their rows stamped.

    ``requests``: open ones (subject_column, subject_id); those that name another column don't count.  Each row
    stays one row however many requests name it.
    """
    mine = requests.filter(col("subject_column") == subject).select(col("subject_id").alias("__subject")).distinct().withColumn("__hit", F.lit(True))
    joined = df.join(mine, col(subject).cast("string") == F.col("__subject"), "left")
    hit, now = F.coalesce(F.col("__hit"), F.lit(False)), at if at is not None else F.current_timestamp()
    changed = {
        m.field: F.when(hit, mask(col(m.field), df.schema[m.field].dataType, m.strategy, salt, None, m.format)).otherwise(col(m.field))
        for m in masks
        if m.field in df.columns and not (m.field == subject and m.strategy == "nullify")
    }
    stamps = {"_dc_is_deleted": (F.lit(True), "boolean"), "_dc_deleted_at": (now, "timestamp"), "_dc_delete_reason": (F.lit(reason), "string")}
    for name, (value, kind) in stamps.items():
        changed[name] = F.when(hit, value).otherwise(col(name) if name in df.columns else F.lit(False if kind == "boolean" else None).cast(kind))
    return joined.withColumns(changed).drop("__subject", "__hit")


def mark(requests: DataFrame, done: DataFrame, status: str, run_id: str, at: Column) -> DataFrame:
    """Open requests among ``done`` (request_id) get a state; closed ones keep theirs."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}; one of {', '.join(STATUSES)}")
    found = done.select(col("request_id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    joined = requests.join(found, col("request_id") == F.col("__id"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False)) & col("status").isin(*OPEN)
    new = {"status": F.lit(status), "processed_at": at.cast("timestamp"), "run_id": F.lit(run_id)}
    return joined.withColumns({k: F.when(hit, v).otherwise(col(k)) for k, v in new.items()}).select(*requests.columns)


def work_off(
    df: DataFrame, requests: SnapshotTable, evidence: SnapshotTable, subject: str, masks: list[Masked], run_id: str, dataset: str, at: datetime,
    system: str | None = None, profile: str = "gdpr", rehearse: bool = False, store: SnapshotTable | None = None,
) -> DataFrame:
    """The frame after all open requests; the requests are marked and what was done is written down.

    With ``rehearse`` nothing changes but the state.  The erased frame goes to ``store`` before a request counts as done.
    """
    spark, known = df.sparkSession, requests.read()
    waiting = open_requests(known, (profile,), system).filter(col("subject_column") == subject)
    out = df if rehearse else erase_requested(df, waiting, subject, masks, F.lit(at))
    subjects = waiting.select("subject_id").distinct()
    n = subjects.count()
    rows = df.join(subjects, col(subject).cast("string") == col("subject_id"), "left_semi").count()
    if store is not None and not rehearse:
        store.write(out)
    status = "dry_run" if rehearse else "completed"
    requests.write(mark(known, waiting, status, run_id, F.lit(at)))
    row = (run_id, at, profile, dataset, dataset, n, rows, "erasure_request", status, None, None, None, system)
    evidence.append(spark.createDataFrame([row], EVIDENCE))
    return out
