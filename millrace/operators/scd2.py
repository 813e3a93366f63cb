"""Full-history dimensions: versions with half-open intervals [effective_from, effective_to).

One window pass per key covers changes in order, late arrivals and several changes
in one batch: existing versions and incoming records are put in order of their start, and
an incoming record becomes a version only if its tracked values differ from the
version in effect at its date.

Kept at all times: no existing ``effective_from`` changes, intervals do not overlap,
real gaps stay, a replayed record adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import all_of, any_of, col
from .merge import last_per_key

OPEN = "9999-12-31"
SENTINEL = "1900-01-01"


@dataclass(frozen=True)
class Scd2:
    keys: tuple[str, ...]
    change_date: str
    track: tuple[str, ...] = ()
    start: str = "effective_from"
    stop: str = "effective_to"
    current: str = "is_current"
    version: str = "_version"
    reason: str = "_change_reason"
    sk: str = "_sk"

    @property
    def control(self) -> tuple[str, ...]:
        return (self.start, self.stop, self.current, self.version, self.reason, self.sk)


def _tracked(df: DataFrame, cfg: Scd2) -> list[str]:
    skip = set(cfg.keys) | set(cfg.control) | {cfg.change_date}
    return list(cfg.track) or [c for c in df.columns if c not in skip and not c.startswith("_dc_")]


def _digest(names: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[col(c).cast("string").alias(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def apply(existing: DataFrame | None, incoming: DataFrame, cfg: Scd2) -> DataFrame:
    """The dimension after a batch.  The first version of a key begins at the sentinel."""
    names = _tracked(incoming, cfg)
    batch = last_per_key(incoming, list(cfg.keys) + [cfg.change_date], [cfg.change_date])
    batch = batch.filter(all_of(col(k).isNotNull() for k in cfg.keys)).select(
        *[col(c) for c in incoming.columns if c not in cfg.control],
        col(cfg.change_date).cast("timestamp").alias("__from"),
        F.lit(None).cast("timestamp").alias("__to"),
        F.lit(True).alias("__new"),
        F.lit(None).cast("timestamp").alias("__was"),
        F.lit(None).cast("string").alias("__reason"),
        _digest(names).alias("__d"),
    )
    first_load = existing is None
    if first_load:
        rows = batch
    else:
        held = existing.select(
            *[col(c) for c in existing.columns if c not in cfg.control],
            col(cfg.start).cast("timestamp").alias("__from"),
            col(cfg.stop).cast("timestamp").alias("__to"),
            F.lit(False).alias("__new"),
            col(cfg.start).cast("timestamp").alias("__was"),
            (col(cfg.reason) if cfg.reason in existing.columns else F.lit(None)).cast("string").alias("__reason"),
            _digest([c if c in existing.columns else c for c in names]).alias("__d"),
        )
        rows = held.unionByName(batch, allowMissingColumns=True)
    key = [col(k) for k in cfg.keys]
    # existing before incoming at one date; the version in effect at a date is the row before it
    order = Window.partitionBy(*key).orderBy(F.col("__from"), F.col("__new"))
    before = rows.withColumns({
        "__prev": F.lag("__d").over(order),
        "__prev_to": F.lag("__to").over(order),
        "__had": F.max(~F.col("__new")).over(Window.partitionBy(*key)),
        "__last_old": F.max(F.when(~F.col("__new"), F.col("__from"))).over(Window.partitionBy(*key)),
        **{f"__p_{c}": F.lag(col(c)).over(order) for c in names},
    })
    in_gap = F.coalesce(F.col("__prev_to") <= F.col("__from"), F.lit(False))  # the version before ended earlier
    changed = F.col("__prev").isNull() | (F.col("__prev") != F.col("__d")) | in_gap
    kept = before.filter(~F.col("__new") | changed)
    order = Window.partitionBy(*key).orderBy(F.col("__from"), F.col("__new"))
    kept = kept.withColumns({"__next": F.lead("__from").over(order), "__n": F.row_number().over(order)})
    # an incoming record at the very date of an existing version replaces its values there
    kept = kept.filter(~(~F.col("__new") & F.coalesce(F.col("__next") == F.col("__from"), F.lit(False)))).withColumns({"__next": F.lead("__from").over(order), "__n": F.row_number().over(order)})
    open_ = F.lit(OPEN).cast("timestamp")
    begins = F.when(F.col("__new") & (F.col("__n") == 1), F.lit(SENTINEL).cast("timestamp")).otherwise(F.col("__from"))
    ends = F.coalesce(F.least(F.col("__next"), F.coalesce(F.col("__to"), open_)), open_)
    late = F.col("__new") & F.coalesce(F.col("__from") < F.col("__last_old"), F.lit(False))
    diffs = F.concat_ws(",", *[F.when(~col(f"__p_{c}").eqNullSafe(col(c)), F.lit(c)) for c in names])
    reason = (
        F.when(~F.col("__new"), F.coalesce(F.col("__reason"), F.lit("initial_load")))
        .when(late, "late_arrival")
        .when(F.col("__n") == 1, "initial_load")
        .otherwise(F.when(diffs == "", "all").otherwise(diffs))
    )
    out = kept.withColumns({cfg.start: begins, cfg.stop: ends, cfg.reason: reason, cfg.version: F.col("__n").cast("long")})
    out = out.withColumn(cfg.current, F.col("__next").isNull() & (col(cfg.stop) == open_))
    sk = F.substring(F.sha2(F.concat_ws("|", *[col(k).cast("string") for k in cfg.keys], F.date_format(col(cfg.start), "yyyy-MM-dd HH:mm:ss")), 256), 1, 16)
    body = [c for c in rows.columns if not c.startswith("__") and not c.startswith("_dc_")]
    tail = [c for c in rows.columns if c.startswith("_dc_")]
    return out.select(sk.alias(cfg.sk), *[col(c) for c in body], cfg.start, cfg.stop, cfg.current, cfg.version, cfg.reason, *[col(c) for c in tail])


def diagnose(dim: DataFrame, cfg: Scd2) -> DataFrame:
    """Faults per version: inverted, overlaps the next, wrong current flag, start shared with another version."""
    order = Window.partitionBy(*[col(k) for k in cfg.keys]).orderBy(col(cfg.start), col(cfg.stop))
    nxt = F.lead(col(cfg.start)).over(order)
    open_end = col(cfg.stop).isNull() | (col(cfg.stop) >= F.lit(OPEN).cast("timestamp"))
    faults = F.array_compact(
        F.array(
            F.when(col(cfg.stop) <= col(cfg.start), "inverted"),
            F.when(nxt == col(cfg.start), "ambiguous_start"),
            F.when((nxt > col(cfg.start)) & (F.coalesce(col(cfg.stop), F.lit(OPEN).cast("timestamp")) > nxt), "overlap"),
            F.when(col(cfg.current) != (nxt.isNull() & open_end), "wrong_current"),
        )
    )
    return dim.withColumn("faults", faults).filter(F.size("faults") > 0)


def repair(dim: DataFrame, cfg: Scd2) -> DataFrame:
    """Intervals put right by the order of their starts; gaps stay, starts never change, ambiguous keys are left alone."""
    order = Window.partitionBy(*[col(k) for k in cfg.keys]).orderBy(col(cfg.start), col(cfg.stop))
    whole = Window.partitionBy(*[col(k) for k in cfg.keys])
    open_ = F.lit(OPEN).cast("timestamp")
    df = dim.withColumn("__next", F.lead(col(cfg.start)).over(order))
    df = df.withColumn("__twice", F.max(F.coalesce(F.col("__next") == col(cfg.start), F.lit(False))).over(whole))
    stop = F.coalesce(col(cfg.stop).cast("timestamp"), open_)
    right = F.when(F.col("__next").isNull(), F.when(stop <= col(cfg.start), open_).otherwise(stop)).otherwise(F.when(stop <= col(cfg.start), F.col("__next")).otherwise(F.least(stop, F.col("__next"))))
    df = df.withColumn("__stop", F.when(F.col("__twice"), col(cfg.stop).cast("timestamp")).otherwise(right))
    current = F.when(F.col("__twice"), col(cfg.current)).otherwise(F.col("__next").isNull() & (F.col("__stop") == open_))
    return df.select(*[F.col("__stop").alias(c) if c == cfg.stop else current.alias(c) if c == cfg.current else col(c) for c in dim.columns])


def at(dim: DataFrame, facts: DataFrame, cfg: Scd2, fact_time: str, fields: list[str], how: str = "left") -> DataFrame:
    """Facts with the fields of the version in effect at their time (point-in-time join)."""
    right = dim.select(*[col(k).alias(f"__k_{k}") for k in cfg.keys], col(cfg.start).alias("__s"), col(cfg.stop).alias("__e"), *[col(f).alias(f"__f_{f}") for f in fields])
    on = all_of([*(col(k) == col(f"__k_{k}") for k in cfg.keys), col(fact_time).cast("timestamp") >= F.col("__s"), col(fact_time).cast("timestamp") < F.col("__e")])
    return facts.join(right, on, how).select(*[col(c) for c in facts.columns], *[col(f"__f_{f}").alias(f) for f in fields])


def changed_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Incoming rows that are new or differ from the existing in a named column, null-safe."""
    right = existing.select(*[col(k).alias(f"__k_{k}") for k in keys], *[col(c).alias(f"__o_{c}") for c in names])
    joined = incoming.join(right, all_of(col(k) == col(f"__k_{k}") for k in keys), "left")
    differs = any_of(~col(c).eqNullSafe(col(f"__o_{c}")) for c in names)
    return joined.filter(col(f"__k_{keys[0]}").isNull() | differs).select(*[col(c) for c in incoming.columns])
