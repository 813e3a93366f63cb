"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source should be taken ``rate = target / size`` times on
average.  The whole part of the rate is taken for certain; the fraction is a
copy probability.  *Pivotal rounding* pairs two rows with fractional
probabilities and moves probability mass between them, in proportion to their
sizes and in a random direction, until one of the two is 0 or 1.  Each move
keeps the expected size of the pair exactly.

*Large rows first.*  In such a pair the smaller row is mostly decided, and the rounding of the
last row left is the whole error.  So the large rows of a source, those of ``LARGE``
of its size or more (200 at most, by that share), are settled before, falling in size: rows of about one size among themselves,
and what is left of them with all smaller rows of the source as one unit, whose common probability takes the mass.

*Reduction tree.*  The other rows of a source are dealt by hash into groups of about
``FAN_IN``.  Each group is folded (one ``aggregate`` over a bounded array) to
decided rows and at most one row that is still fractional.  These residuals are
the rows of the next level, until one residual a source is left; it is rounded
at random.  A hot source only makes more groups.

What a source takes differs from its target by less than ``LARGE`` of its size,
or, where its smaller rows hold too little to make up for a large one, by less than
what that one lacks; always by less than one row.

Rows that are alike in ``key``, ``source`` and ``size`` are one unit with a row count
before anything is dealt: pairing equals among themselves leaves the whole part
of ``count * fraction`` rows taken and one residual, which is written down
directly.  So repeated rows can't make a group large.

Everything is DataFrame functions.  The random numbers are hashes of the key
and a seed: reruns agree, on any number of executors.

Defined results: a null text has size 0; rows of size 0 are taken 0 times; null
is a source of its own and comes last; null keys are ordinary keys; rows alike share
their copies evenly, ties in size go by a hash of the key; an empty table gives no rows.
:func:`mixed_rows` keeps all columns, whatever their names and types.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, uniform

#: rows of a group of the reduction tree, on average
FAN_IN = 64
#: weights of the sources in order of code points, repeating
WEIGHTS = (3.0, 1.0, 2.0)
#: sources up to which their table (some 60 bytes a source) is broadcast
BROADCAST_SOURCES = 2_000
#: share of its source's size from which a row is large
LARGE = 0.005
#: probabilities this near to 0 or 1 are whole
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """(source, source_size, n_rows, target, s_id) a source, and how many there are.

    ``sizes`` has one row per source: source, source_size, n_rows.  Weights
    repeat in the order of sources, null last.  No target is above ``cap`` times its
    source; what a capped source gives up is shared by weight among the others
    until none is above.  That is a level ``t`` with ``sum(min(cap * size, t *
    weight)) = share * total``; the loop is Newton's method on that concave
    function, each round one aggregate over the sources with two numbers as its result.
    """
    # ranks without one task for all sources: sorted ranges, then an offset a range
    ranged = scratch.cut(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, n = {}, 0
    for part in sorted(counts):
        offsets[part], n = n, n + counts[part]
    if not n:
        empty = ranged.select("source", "source_size", "n_rows", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("s_id"))
        return scratch.cut(empty), 0
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part"))
    rank = start + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = scratch.cut(
        ranged.withColumn("s_id", rank.cast("long")).withColumn("weight", F.element_at(cycle, (F.col("s_id") % len(weights) + 1).cast("int")))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    want, level = share * total, 0.0
    limit = F.col("source_size") * F.lit(cap)
    while total:
        capped = limit <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            level = math.inf
            break
        new = (want - row[0]) / row[1]
        if new <= level * (1 + 1e-15):
            break
        level = new
    target = F.least(limit, F.lit(level) * F.col("weight")) if total else F.lit(0.0)
    out = scratch.cut(ranked.select("source", "source_size", "n_rows", target.cast("double").alias("target"), "s_id"))
    scratch.drop(ranged, ranked)
    return out, n


def _fold() -> Column:
    """Pivotal rounding along an array of units: struct(res, done)."""
    unit = "struct<size:bigint,u:double,p:double,unit:bigint,key:string>"
    done = "array<struct<unit:bigint,key:string,size:bigint,x:int>>"
    whole = lambda p: (p <= EPS) | (p >= 1 - EPS)

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["u"].alias("u"), p.alias("p"), x["unit"].alias("unit"), x["key"].alias("key")).cast(unit)

    def step(acc: Column, y: Column) -> Column:
        x = acc["res"]
        ratio = y["size"] / x["size"]  # mass that y gives is worth so much to x
        up = F.least(1 - x["p"], y["p"] * ratio)  # x up, y down
        down = F.least(x["p"], (1 - y["p"]) * ratio)  # x down, y up
        move = F.when(y["u"] * (up + down) < down, up).otherwise(-down)
        px = x["p"] + move
        py = y["p"] - move / ratio
        clean = lambda p: F.when(p <= EPS, 0.0).when(p >= 1 - EPS, 1.0).otherwise(p)
        # bound once, in a lambda's variable, then used for both rows
        pair = F.struct(clean(px).alias("px"), clean(py).alias("py"))
        return F.transform(
            F.array(pair),
            lambda q: F.struct(
                F.when(whole(q["px"]) & whole(q["py"]), F.lit(None).cast(unit)).when(whole(q["px"]), with_p(y, q["py"])).otherwise(with_p(x, q["px"])).alias("res"),
                F.concat(
                    acc["done"],
                    F.when(whole(q["px"]), F.array(_fact(x, q["px"]))).otherwise(F.array().cast(done)),
                    F.when(whole(q["py"]), F.array(_fact(y, q["py"]))).otherwise(F.array().cast(done)),
                ).cast(done).alias("done"),
            ),
        )[0]

    def _fact(x: Column, p: Column) -> Column:
        return F.struct(x["unit"].alias("unit"), x["key"].alias("key"), x["size"].alias("size"), F.when(p >= 0.5, 1).otherwise(0).alias("x"))

    start = F.struct(F.lit(None).cast(unit).alias("res"), F.array().cast(done).alias("done"))

    def begin(acc: Column, y: Column) -> Column:
        fresh = F.struct(with_p(y, y["p"]).alias("res"), acc["done"].alias("done"))
        return F.when(acc["res"].isNull(), fresh).otherwise(step(acc, y))

    return F.aggregate(F.col("units"), start, begin)


def _settle() -> Column:
    """Pivotal rounding of large rows, falling in size: struct(f, rest, res, done).

    Rows of about one size are paired with each other; what is left of them, when rows of less than half
    its size come, is paired with all rows not settled yet as one unit.  ``f``: the probability of the rows that aren't alike
    with others; ``rest``: their size, of those not settled yet.
    """
    fact = "struct<unit:bigint,key:string,size:bigint,x:int>"
    row = "struct<size:bigint,v:double,u:double,p:double,unit:bigint,key:string>"
    state = f"struct<f:double,rest:double,res:{row},done:array<{fact}>>"
    nothing = F.lit(None).cast(row)
    whole = lambda p: (p <= EPS) | (p >= 1 - EPS)
    clean = lambda p: F.when(p <= EPS, 0.0).when(p >= 1 - EPS, 1.0).otherwise(p)

    def bind(value: Column, then) -> Column:  # noqa: ANN001 - a name for a value inside a lambda
        return F.transform(F.array(value), then)[0]

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["v"].alias("v"), x["u"].alias("u"), p.alias("p"), x["unit"].alias("unit"), x["key"].alias("key")).cast(row)

    def facts(ok: Column, x: Column, p: Column) -> Column:
        """One decided row; a fractional one, where the rest has nothing left to give, is rounded at random."""
        one = F.struct(x["unit"].alias("unit"), x["key"].alias("key"), x["size"].alias("size"), F.when(x["v"] < p, 1).otherwise(0).alias("x"))
        return F.when(ok, F.array(one)).otherwise(F.array()).cast(f"array<{fact}>")

    def settle(acc: Column) -> Column:
        """The state with ``res`` decided against all the rest."""
        x = acc["res"]
        ratio = acc["rest"] / x["size"]
        up, down = F.least(1 - x["p"], acc["f"] * ratio), F.least(x["p"], (1 - acc["f"]) * ratio)
        return bind(
            F.struct(up.alias("up"), down.alias("down")),
            lambda m: bind(
                F.when(m["up"] + m["down"] <= EPS, 0.0).when(x["u"] * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]),
                lambda go: F.struct(
                    F.when(acc["rest"] > 0, clean(acc["f"] - go / ratio)).otherwise(acc["f"]).alias("f"),
                    acc["rest"].alias("rest"),
                    nothing.alias("res"),
                    F.concat(acc["done"], facts(F.lit(True), x, clean(x["p"] + go))).alias("done"),
                ).cast(state),
            ),
        )

    def pair(acc: Column, y: Column) -> Column:
        """The state after ``res`` and a row of about its size."""
        x = acc["res"]
        ratio = y["size"] / x["size"]
        up, down = F.least(1 - x["p"], y["p"] * ratio), F.least(x["p"], (1 - y["p"]) * ratio)
        go = F.when(y["u"] * (up + down) < down, up).otherwise(-down)
        return bind(
            F.struct(clean(x["p"] + go).alias("x"), clean(y["p"] - go / ratio).alias("y")),
            lambda p: F.struct(
                acc["f"].alias("f"),
                acc["rest"].alias("rest"),
                F.when(whole(p["x"]) & whole(p["y"]), nothing).when(whole(p["x"]), with_p(y, p["y"])).otherwise(with_p(x, p["x"])).alias("res"),
                F.concat(acc["done"], facts(whole(p["x"]), x, p["x"]), facts(whole(p["y"]), y, p["y"])).alias("done"),
            ).cast(state),
        )

    def take(acc: Column, y: Column) -> Column:
        """The state with a further row, which is no part of the rest any more."""
        p = F.when(y["m"] > 1, y["p"]).otherwise(acc["f"])
        after = F.when(y["m"] > 1, acc["rest"]).otherwise(F.greatest(acc["rest"] - y["size"], F.lit(0.0)))
        fresh = F.struct(acc["f"].alias("f"), after.alias("rest"), acc["res"].alias("res"), acc["done"].alias("done")).cast(state)
        return bind(
            F.struct(fresh.alias("acc"), with_p(y, p).alias("y")),
            lambda b: F.when(
                whole(b["y"]["p"]),
                F.struct(b["acc"]["f"].alias("f"), b["acc"]["rest"].alias("rest"), b["acc"]["res"].alias("res"), F.concat(b["acc"]["done"], facts(F.lit(True), b["y"], b["y"]["p"])).alias("done")).cast(state),
            )
            .when(b["acc"]["res"].isNull(), F.struct(b["acc"]["f"].alias("f"), b["acc"]["rest"].alias("rest"), b["y"].alias("res"), b["acc"]["done"].alias("done")).cast(state))
            .otherwise(pair(b["acc"], b["y"])),
        )

    def step(acc: Column, y: Column) -> Column:
        return bind(F.when(acc["res"].isNotNull() & (y["size"] * 2 < acc["res"]["size"]), settle(acc)).otherwise(acc), lambda a: take(a, y))

    start = F.struct(F.col("f").alias("f"), F.col("rest").alias("rest"), nothing.alias("res"), F.array().cast(f"array<{fact}>").alias("done")).cast(state)
    return F.aggregate(F.col("units"), start, step, lambda acc: F.when(acc["res"].isNull(), acc).otherwise(settle(acc)))


def decide(units: DataFrame, scratch: Scratch, targets: DataFrame, n_sources: int, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of every unit: adds source_size, target and copies (of all the unit's rows).

    ``units``: key (string), source, size, m (rows alike).
    """
    small = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.when(F.col("size") > 0, F.floor("rate")).otherwise(0)
    part = F.when(F.col("size") > 0, (F.col("rate") - F.floor("rate")) * F.col("m")).otherwise(0.0)
    start = (
        units.alias("a")
        .join(small.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select("a.key", "a.source", "a.size", "a.m", "b.source_size", "b.target", "b.s_id", "b.n_rows")
        .withColumn("rate", rate)
        .withColumn("mass", part)
        .withColumn("certain", (base * F.col("m") + F.floor(F.col("mass") + EPS)).cast("long"))
        .withColumn("p", F.greatest(F.col("mass") - F.floor(F.col("mass") + EPS), F.lit(0.0)))
        .withColumn("unit", F.xxhash64("key", "size", F.lit(seed)))
    )
    carry = ["s_id", "source_size", "target"]
    as_key = F.to_json(F.struct("key", "size", "m", "certain", "source"), {"ignoreNullFields": "false"})
    open_ = start.filter("p > 0").select(*carry, "n_rows", "size", "m", "p", "unit", as_key.alias("key"), (F.col("size") >= F.col("source_size") * F.lit(LARGE)).alias("large"))
    # large rows, and the probability that they leave to the others
    large = F.struct("size", uniform("unit", "key", F.lit(seed), F.lit(-1)).alias("u"), uniform("unit", "key", F.lit(seed), F.lit(-2)).alias("v"), "m", "p", "unit", "key")
    heads = scratch.cut(
        open_.groupBy(*carry)
        .agg(
            F.max(F.when(F.col("m") == 1, F.col("p"))).alias("f"),
            F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("size"))), F.lit(0)).cast("double").alias("rest"),
            F.sort_array(F.collect_list(F.when(F.col("large"), large)), asc=False).alias("units"),
        )
        .select(*carry, _settle().alias("s"))
    )
    settled = heads.select(*carry, F.explode("s.done").alias("d")).select(*carry, "d.key", "d.x")
    others = heads.select(F.col("s_id"), F.col("s.f").alias("f"))
    others = F.broadcast(others) if n_sources <= BROADCAST_SOURCES else others
    open_ = open_.filter("not large").join(others, "s_id").withColumn("p", F.when(F.col("m") > 1, F.col("p")).otherwise(F.col("f")))

    def groups_of(n: Column) -> Column:
        return F.greatest(F.ceil(n / F.lit(float(fan_in))), F.lit(1)).cast("long")

    level, left = 0, None
    whole = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
    decided = [settled, open_.filter(whole).select(*carry, "key", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("x"))]
    rows = open_.filter(~whole).select(*carry, groups_of(F.col("n_rows")).alias("groups"), "size", "p", "unit", "key")
    most = targets.agg(F.max(groups_of(F.col("n_rows")))).first()[0] or 1
    while True:
        u = uniform("unit", "key", F.lit(seed), F.lit(level))
        dealt = rows.select(
            *carry, "groups", F.struct("size", u.alias("u"), "p", "unit", "key").alias("x"),
            F.pmod(F.xxhash64("unit", "key", F.lit(seed + 1), F.lit(level)), F.col("groups")).alias("g"),
        )
        folded = dealt.groupBy(*carry, "groups", "g").agg(F.sort_array(F.collect_list("x"), asc=False).alias("units"))
        out = scratch.cut(folded.select(*carry, "groups", _fold().alias("f")).select(*carry, "groups", "f.res", "f.done"))
        decided.append(out.select(*carry, F.explode("done").alias("d")).select(*carry, "d.key", "d.x"))
        left = out.filter("res is not null").select(*carry, groups_of(F.col("groups")).alias("groups"), "res.size", "res.p", "res.unit", "res.key")
        if most <= 1:
            break
        rows, most, level = left, math.ceil(most / fan_in), level + 1
    last = F.when(uniform("unit", "key", F.lit(seed), F.lit(99)) < F.col("p"), 1).otherwise(0)
    decided.append(left.select(*carry, "key", last.alias("x")))
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.unionByName(d)
    row = F.from_json("key", "key string, size bigint, m bigint, certain bigint, source string")
    chosen = chosen.select(*carry, "x", row.alias("r")).select("r.key", "r.source", "r.size", "r.m", "source_size", "target", (F.col("r.certain") + F.col("x")).alias("copies"))
    sure = start.filter("p <= 0").select("key", "source", "size", "m", "source_size", "target", F.col("certain").alias("copies"))
    return chosen.unionByName(sure)


def mix(rows: DataFrame, scratch: Scratch, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Units with their copies, from ``rows``: key (string), source (string), size (long)."""
    units = scratch.cut(rows.groupBy("key", "source", "size").agg(F.count("*").alias("m")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_rows"))
    targets, n = source_targets(sizes, scratch, share, cap, weights)
    return decide(units, scratch, targets, n, seed)


def per_row(units: DataFrame) -> DataFrame:
    """One row for each input row; a unit's copies are dealt evenly to its rows."""
    each = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("i") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    return each.withColumn("copies", copies.cast("long")).drop("i", "m")


def mixed_rows(df: DataFrame, scratch: Scratch, text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``df`` that the mix takes, repeated as often as it takes them.

    Rows are known by a digest of all their columns, nulls in their places; rows that are alike in
    all of them are interchangeable and are kept once and repeated.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    # by place, so that columns of one name don't matter
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    key = F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)
    keyed = df.select(key.alias("key"), whole.alias("row"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    taken = scratch.cut(mix(keyed.drop("row"), scratch, **how).filter("copies > 0").select("key", "m", "copies"))
    keyed = keyed.select("key", "row")
    out = keyed.join(taken.filter("m = 1"), "key").select("copies", "row")
    many = taken.filter("m > 1")
    if not many.isEmpty():
        out = out.unionByName(keyed.join(many, "key").groupBy("key", "copies").agg(F.first("row").alias("row")).select("copies", "row"))
    out = out.select(F.explode(F.expr("sequence(1L, copies)")).alias("i"), "row")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
