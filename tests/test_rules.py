import pytest
from pyspark.sql import functions as F

from millrace.operators import dataset_rules as D
from millrace.operators import rules as R
from millrace.operators.schema import Field, Policy, enforce, flatten
from millrace.plans.contract import ContractError, load
from millrace.plans.processor import DatasetRuleFailed, Processor, QuarantineNotAllowed


def test_split_rejects_false_and_null(spark):
    df = spark.createDataFrame([(1,), (-1,), (3,), (None,)], "val bigint")
    good, bad = R.split(R.evaluate(df, [R.custom("positive", "val > 0")]))
    assert sorted(r.val for r in good.collect()) == [1, 3]
    row = bad.filter("val = -1").first()
    assert row[R.ERRORS] == ["[pre] Rule failed: positive (val > 0)"] and row[R.STATE] == "active" and row[R.REPROCESSED] is False
    assert good.columns == ["val"]


def test_milestone_with_mixed_types(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-02"), (None, "2024-01-02"), ("2024-01-01", None)], "a string, b string")
    df = df.withColumn("a", F.to_date("a")).withColumn("b", F.to_timestamp("b"))
    good, bad = R.split(R.evaluate(df, [R.milestone("a", "b")]))
    assert good.count() == 3 and bad.count() == 1


def test_lifecycle_window(spark):
    ref = spark.createDataFrame([(1, "2024-01-01", "2024-01-31"), (2, "2024-02-01", None)], "k int, s string, e string")
    ev = spark.createDataFrame([(1, "2024-01-15"), (1, "2024-03-01"), (2, "2030-01-01"), (9, "2024-01-01")], "k int, ts string")
    good, _ = R.split(R.evaluate(ev, [R.lifecycle_window("ts", "k", ref, "k", "s", "e")]))
    assert sorted((r.k, r.ts) for r in good.collect()) == [(1, "2024-01-15"), (2, "2030-01-01")]


def test_schema_enforcement_reports_types(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "id string, n string")
    out, errors = enforce(df, [Field("id", "bigint"), Field("n", "decimal(4,1)"), Field("extra", "date")], Policy())
    ev = R.evaluate(out, [], errors)
    bad = ev.filter(F.size(R.ERRORS) > 0).collect()
    assert len(bad) == 1 and bad[0][R.ERRORS] == ["Type Mismatch: n exceeds decimal(4,1) or is not a number"]
    assert dict(out.dtypes)["extra"] == "date"


def test_strict_policy_marks_every_row(spark):
    out, errors = enforce(spark.range(3), [Field("id", "bigint"), Field("x", "int"), Field("y", "int")], Policy("strict"))
    assert R.split(R.evaluate(out, [], errors))[1].first()[R.ERRORS] == ["Missing fields: x, y"]


def test_flatten_structs_and_lists(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('n', 'a', 'addr', named_struct('city', 'x')) AS c, array(1, 2) AS l")
    assert flatten(df).first().asDict() == {"id": 1, "c_n": "a", "c_addr_city": "x", "l": "[1,2]"}


def test_scope_quarantines_failing_groups_only(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("B", 1), ("B", 2), ("C", 1), (None, 5)], "symbol string, ts long")
    good, bad = D.split_by_scope(df, D.unique("ts", scope=("symbol",)))
    assert {r.symbol for r in bad.collect()} == {"A"} and good.count() == 4


def test_null_result_passes_only_without_rows(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    rules = [D.statement("none_there", "SELECT sum(b) FROM source WHERE a > 5", less_than=1), D.statement("null_there", "SELECT sum(b) FROM source WHERE a > 0", less_than=1)]
    assert [r.passed for r in D.check(df, rules)] == [True, False]


def _contract(**more):
    return {"name": "c", "model": {"fields": [{"name": "id", "type": "bigint", "required": True}, {"name": "v", "type": "double"}]}, "lineage": {"enabled": False}} | more


def test_processor_orders_phases(spark):
    c = _contract(
        transformations=[{"derive": {"field": "w", "sql": "v * 2"}}, {"rename": {"raw": "v"}}],
        quality={"row_rules": [{"name": "v_pos", "sql": "v > 0"}, {"name": "w_small", "sql": "w < 10"}]},
    )
    df = spark.createDataFrame([(1, "1.5"), (2, "-1"), (3, "7"), (None, "2"), (5, "abc")], "id bigint, raw string")
    good, bad = Processor(c, spark).run(df)
    assert [(r.id, r.v, r.w) for r in good.collect()] == [(1, 1.5, 3.0)]
    errors = {r.id: r[R.ERRORS] for r in bad.collect()}
    assert errors[3] == ["[post] Rule failed: w_small (w < 10)"] and errors[2][0].startswith("[pre]") and "Type Mismatch" in errors[5][0]
    assert errors[None] == ["[pre] Rule failed: id_required (id IS NOT NULL)"]


def test_dataset_failure_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id bigint, v double")
    with pytest.raises(DatasetRuleFailed):
        Processor(_contract(primary_key=["id"], quarantine={"on_dataset_failure": "stop"}), spark).run(df)
    good, bad = Processor(_contract(quality={"dataset_rules": [{"unique": "id", "quarantine_scope": "id"}]}, quarantine={"on_dataset_failure": "quarantine"}), spark).run(df)
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(QuarantineNotAllowed):
        Processor(_contract(quality={"row_rules": [{"name": "n", "sql": "v > 1"}]}, quarantine={"enabled": False}), spark).run(df)


def test_contract_refuses_unknown_keys_and_wrong_facts():
    with pytest.raises(ContractError, match="unknown keys"):
        load({"name": "x", "qualty": {}})
    with pytest.raises(ContractError, match="append"):
        load({"name": "x", "materialization": {"fact_type": "transaction", "strategy": "merge"}})


def test_yaml_keeps_on_and_off_as_text():
    c = load("name: x\nquality:\n  row_rules:\n    - accepted_values: {field: s, values: [on, off]}\n")
    assert c.row_rules[0]["accepted_values"]["values"] == ["on", "off"]


def test_stage_overrides():
    c = load({"name": "x", "materialization": {"strategy": "append", "a": 1}, "stages": {"gold": {"materialization": {"strategy": "merge"}, "primary_key": ["id"]}}}, "gold")
    assert c.materialization == {"strategy": "merge", "a": 1} and c.primary_key == ["id"]
