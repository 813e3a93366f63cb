from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import masking as K
from millrace.operators import generate as Gen
from millrace.operators import governance as G
from millrace.operators import profile as P
from millrace.operators import slo as O
from millrace.operators.schema import Field
from millrace.plans import authoring as A
from millrace.plans.contract import load
from millrace.plans.pipeline import Cycle, Options, Pipeline, downstream, waves


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "value,want",
    [("joe@mail.com", "j***@mail.com"), ("+44 20 7946 0958", "***-***-0958"), ("Alice", "A***e"), ("Al", "**"), (None, None), ("", "")],
)
def test_partial_mask(spark, value, want):
    assert one(spark, value, K.partial) == want


def test_hash_is_idempotent(spark):
    h = one(spark, "x", K.hashed)
    assert one(spark, h, K.hashed) == h and one(spark, h[:-1], K.hashed) != h[:-1]


def test_format_tokens(spark):
    assert one(spark, "joe@mail.com", lambda c: K.formatted(c, "{first2}~{domain}")) == "jo~mail.com"
    assert one(spark, "card 1234 5678", lambda c: K.formatted(c, "*{last4}")) == "*5678"


def test_encrypt_needs_a_key(spark):
    with pytest.raises(ValueError):
        K.encrypted(F.col("v"), "short")


def test_erase_touches_only_subjects(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    out = {r.id: r for r in G.erase(df, "id", [1], [G.Masked("name", "nullify"), G.Masked("id", "nullify")]).collect()}
    assert out[1].name is None and out[1]["_dc_is_deleted"] and out[2].name == "b" and not out[2]["_dc_is_deleted"]


def test_lineage_preserves_upstream(spark):
    a = G.lineage(spark.range(1), G.RunInfo("r1", "bronze"))
    b = G.lineage(a, G.RunInfo("r2", "silver"), upstream_prefix="_up_")
    assert b.first()["_up_run_id"] == "r1" and b.first()["_dc_run_id"] == "r2"


def test_double_hash_verdicts(spark):
    clear = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e")], "k int, v string")
    h = F.sha2("v", 256)
    stored = clear.filter("k <> 5").withColumn("v", F.when(F.col("k") == 1, h).when(F.col("k") == 2, F.sha2(h, 256)).when(F.col("k") == 3, "zzz"))
    got = {r.verdict: r.rows for r in G.double_hash(clear, stored, "k", "v").collect()}
    assert got == {"consistent": 1, "double_hashed": 1, "indeterminate": 1, "null": 1, "unjoined": 1}


def _runs(spark, counts):
    rows = [("d", "prod", datetime(2024, 1, 1 + i), c) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "dataset string, environment string, timestamp timestamp, counts_good bigint")


@pytest.mark.parametrize("current,want", [(100, "normal"), (40, "drop"), (300, "spike"), (5, "critical"), (0, "critical")])
def test_row_count_anomaly(spark, current, want):
    runs = _runs(spark, [90, 100, 110, 100, 0, 105])
    assert O.row_count_anomaly(runs, current, datetime(2024, 2, 1), "d", "prod").first().verdict == want
    assert O.row_count_anomaly(runs, current, datetime(2024, 2, 1), "d", "test").first().verdict == "insufficient_history"


def test_quality_gate():
    assert [O.quality_gate(0, 0), O.quality_gate(0, 5), O.quality_gate(0, 5, 0.9), O.quality_gate(95, 5, 0.9, 0.1), O.quality_gate(80, 20, 0.9)] == ["none", "warn", "fail", "pass", "fail"]


def test_freshness_of_nothing_fails(spark):
    row = O.freshness(spark.createDataFrame([], "t timestamp"), "t", 60, F.lit("2024-01-01")).first()
    assert row.passed is False and row.reason == "no_data_or_threshold"


def test_discover_key(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"), (F.col("id") % 3).alias("c"))
    assert P.discover_key(df) == ["a", "b"]


def test_pii(spark):
    assert P.pii_by_name(["customerEmail", "amount", "first_name"]) == ["customerEmail", "first_name"]
    df = spark.createDataFrame([("a@b.com", "x"), ("c@d.org", "y")], "m string, n string")
    assert [(r.column, r.kind) for r in P.pii_by_value(df).collect()] == [("m", "email")]


def test_date_dimension_holidays(spark):
    d = {str(r.date): r for r in Gen.date_dimension(spark, "2024-01-01", "2024-12-31", today="2024-06-01").collect()}
    assert d["2024-03-29"].holiday_name == "Good Friday" and d["2024-08-26"].holiday_name == "Summer Bank Holiday" and d["2024-12-30"].iso_year == 2025
    us = {str(r.date): r.holiday_name for r in Gen.date_dimension(spark, "2024-01-01", "2024-12-31", "US").collect()}
    assert us["2024-11-28"] == "Thanksgiving Day" and us["2024-09-02"] == "Labor Day" and us["2024-05-27"] == "Memorial Day"


def test_synthetic_rows_satisfy_or_say_why(spark):
    fields = [Field("id", "bigint", True), Field("s", "string", accepted_values=("a", "b")), Field("v", "double", min=0, max=10)]
    df = Gen.synthesize(spark, fields, 2000, ["id"], 0.2)
    bad = df.filter("_dc_test_case is not null").count()
    assert 250 < bad < 550
    assert df.filter("_dc_test_case is null and (id is null or s not in ('a','b') or v < 0 or v > 10)").count() == 0
    assert df.filter("_dc_test_case = 'v: above maximum' and v <= 10").count() == 0


def test_lint_codes():
    codes = lambda c: {f.code for f in A.lint(c)}
    dedup = lambda **c: {"name": "x", "primary_key": ["id"], "transformations": [{"deduplicate": {"on": ["id"], **c}}]}
    assert "PK-002" in codes({"name": "x", "materialization": {"strategy": "merge"}}) and "PK-002" not in codes(dedup(sort_by=["at"]))
    assert "KEY-001" in codes(dedup()) and "KEY-001" not in codes(dedup(sort_by=["at"]))
    assert "KEY-002" in codes(dedup(sort_by=["ID"])) and "KEY-002" not in codes(dedup(sort_by=["id", "at"]))
    assert "KEY-003" in codes({"name": "x", "natural_key": ["a"]})
    merge = {"name": "x", "layer": "silver", "primary_key": ["id"], "materialization": {"strategy": "merge"}}
    assert {"DEL-001", "VOL-001", "QLT-001"} <= codes(merge)
    kept = merge | {"soft_deletes": {"enabled": True}, "service_levels": {"freshness": {"threshold": "1h", "field": "at"}}, "quality": {"row_rules": [{"not_null": "id"}]}}
    assert not {"DEL-001", "VOL-001", "QLT-001"} & codes(kept)
    assert "SENS-001" in codes({"name": "x", "model": {"fields": [{"name": "a", "sensitive": True}]}})
    assert {"STREAM-001", "STREAM-002"} <= codes({"name": "x", "source": {"trigger": "continuous"}, "materialization": {"strategy": "append"}})
    assert "SRC-001" in codes({"name": "x", "layer": "bronze", "source": {"type": "landing"}})
    assert {"OWN-001", "OWN-002"} <= codes({"name": "x", "ownership": {"technical_owner": {"person": "p"}}})
    post = {"derive": {"field": "net", "sql": "1", "phase": "post"}}
    assert "PHS-001" in codes({"name": "x", "transformations": [post], "quality": {"row_rules": [{"name": "r", "sql": "net > 0", "phase": "pre"}]}})
    assert "TRF-001" in codes({"name": "x", "transformations": [{"nope": {}}]})
    assert "PARSE-000" in codes({"nam": "x"})
    assert {"PII-001", "SCD-001"} <= codes({"name": "x", "primary_key": ["id"], "materialization": {"strategy": "scd2"}, "model": {"fields": [{"name": "id"}, {"name": "email"}]}})


def test_gates_ddl_and_round_trips(spark):
    old = load({"name": "x", "model": {"fields": [{"name": "a", "type": "int"}, {"name": "b", "type": "string"}]}})
    new = load({"name": "x", "model": {"fields": [{"name": "a", "type": "bigint"}, {"name": "c", "type": "date"}]}})
    assert A.breaking_changes(old, new) == ["field removed: b"]
    assert A.alter_table("t", old.fields, new.fields) == ["ALTER TABLE t ALTER COLUMN a TYPE BIGINT", "ALTER TABLE t ADD COLUMNS (c DATE)"]
    assert "DOUBLE PRECISION" in A.create_table("t", [Field("v", "double")], "postgres")
    spark.sql(A.create_table("made_here", new.fields))
    assert spark.table("made_here").dtypes == [("a", "bigint"), ("c", "date")]
    spark.sql("DROP TABLE made_here")
    back = load(A.from_odcs(A.to_odcs(load({"name": "x", "primary_key": ["a"], "model": {"fields": [{"name": "a", "type": "int", "required": True}]}}))))
    assert back.primary_key == ["a"] and back.fields[0].required


def test_infer_a_contract(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"), (F.col("id") * 1.5).alias("v"), F.lit("a@b.c").alias("email"))
    c = A.infer(df, "n")
    f = {x["name"]: x for x in c["model"]["fields"]}
    assert c["primary_key"] == ["id"] and f["kind"]["accepted_values"] == ["x", "y"] and f["v"]["min"] == 0 and f["email"]["pii"]
    load(c)


def test_dbt_import():
    m = {"name": "m", "columns": [{"name": "a", "tests": ["not_null", "unique", {"accepted_values": {"values": [1, 2]}}]}]}
    c = load(A.from_dbt(m))
    assert c.fields[0].required and c.fields[0].accepted_values == (1, 2) and c.dataset_rules == [{"unique": "a"}]


def test_waves_and_downstream():
    dep = {"a": [], "b": ["a"], "c": ["a", "outside"], "d": ["b", "c"]}
    assert waves(dep) == [["a"], ["b", "c"], ["d"]] and downstream(dep, ["b"]) == ["b", "d"]
    with pytest.raises(Cycle):
        waves({"a": ["b"], "b": ["a"]})


def test_pipeline_retries_and_skips():
    tries = []

    def step(c):
        tries.append(c.name)
        if c.name == "b":
            raise RuntimeError("no")
        return {"good": 1}

    make = lambda n, layer, deps=(): load({"name": n, "layer": layer, "depends_on": list(deps)})
    out = Pipeline([make("a", "bronze"), make("b", "silver", ["a"]), make("c", "gold", ["b"]), make("d", "gold", ["a"])], step, Options(retries=1, wait_s=0)).run()
    assert {n: o.status for n, o in out.items()} == {"a": "success", "b": "failed", "c": "skipped", "d": "success"} and tries.count("b") == 2


def test_exact_profile_sorts_nothing_and_counts_all(spark):
    rows = [(i % 3 if i else None, ["b", "äö", "", None][i % 4], [0.0, -0.0, float("nan"), 1.5][i % 4], i % 2 == 0, bytes([i % 2]), [i], {"a": i} if i else None, datetime(2024, 1, 1 + i % 5), i) for i in range(40)]
    df = spark.createDataFrame(rows, "`a.b` int, s string, d double, t boolean, y binary, l array<int>, m map<string,int>, at timestamp, `select` bigint").withColumn("v", F.lit(None))
    for frame in (df, df.limit(0), df.select("s")):
        out = P.profile(frame, {"at"}, exact=True)
        got = {r["column"]: r for r in out.collect()}
        for f, r in zip(frame.schema, P.profile(frame, {"at"}).collect(), strict=True):  # all but distincts
            assert got[f.name].asDict() | {"distinct": 0} == r.asDict() | {"distinct": 0}
            bare = f.name in ("y", "l", "m")
            assert got[f.name]["distinct"] == (None if bare else frame.select(F.count_distinct(f"`{f.name}`")).first()[0])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" not in plan and "Expand" not in plan
    assert {n: P.exact_distincts(df, ["s", "d", "a.b"]).first()[n] for n in ("s", "d", "a.b")} == {"s": 3, "d": 3, "a.b": 3}


def test_key_discovery_with_nulls_and_without_columns(spark):
    df = spark.range(40).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") % 8).cast("string").alias("b"), F.floor(F.col("id") / 8).cast("string").alias("c"), F.lit(1).alias("d"))
    assert P.discover_key(df) == ["b", "c"] and P.discover_key(df, names=["a", "b"]) is None
    assert P.discover_key(df.select(F.array("a").alias("x"))) is None and P.discover_key(df.limit(0)) is None
