from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.__main__ import main
from millrace.operators import fleet as Fl
from millrace.operators import rules as R
from millrace.sources import sinks
from millrace.sources.rest import RestSource, pages, read_rest


def test_fleet(spark):
    rows = [("a", "success", datetime(2024, 1, 1), 10), ("a", "success", datetime(2024, 1, 3), 30), ("b", "failed", datetime(2024, 1, 3), 0), ("b", "success", datetime(2023, 12, 1), 5)]
    runs = spark.createDataFrame(rows, "dataset string, status string, timestamp timestamp, counts_good bigint")
    got = {r.dataset: r.passed for r in Fl.fleet_freshness(runs, {"a": 48}, F.lit("2024-01-04")).collect()}
    assert got == {"a": True, "b": False}
    assert {r.dataset: (r.runs, r.rows, r.failed) for r in Fl.fleet_volume(runs).collect()} == {"a": (2, 40, 0), "b": (2, 5, 1)}


def test_schema_drift():
    old = T.StructType.fromDDL("a int, b string, c date")
    new = T.StructType.fromDDL("a bigint, b int, d string")
    assert {(d.column, d.kind) for d in Fl.schema_drift(old, new)} == {("c", "removed"), ("a", "widened"), ("b", "retyped"), ("d", "added")}


def test_rule_checks_look_only_at_new_rows(spark):
    df = spark.range(10).withColumn("v", F.col("id") - 3)
    rules = [R.custom("pos", "v > 0")]
    out, memo = Fl.run_check(df, rules, None, "id")
    assert memo["scope"] == "full" and out.first().failed_rows == 4
    assert Fl.run_check(df, rules, memo, "id")[0] is None
    more = spark.range(12).withColumn("v", F.lit(-1))
    out, memo = Fl.run_check(more, rules, memo, "id")
    assert memo["scope"] == "changed" and tuple(out.first()) == ("pos", 2, 2)
    assert Fl.rule_results(out, "r", datetime(2024, 1, 1)).first().status == "failed"
    assert Fl.run_check(more, [R.custom("pos", "v > 5")], memo, "id")[1]["scope"] == "full"


@pytest.mark.parametrize("how", ["page", "offset", "cursor"])
def test_rest_pages(spark, tmp_path, how):
    calls = []

    def fetch(url, params, headers):
        calls.append(params)
        if len(calls) == 1:
            raise OSError("once")
        at = {"page": lambda: (params["page"] - 1) * 2, "offset": lambda: params["offset"], "cursor": lambda: params.get("cursor", 0)}[how]() if how != "cursor" else params.get("cursor", 0)
        return {"data": {"items": [{"id": i} for i in range(at, min(at + 2, 5))]}, "next": at + 2 if at + 2 < 5 else None}

    src = RestSource("http://x", how, "data.items", page_size=2, wait_s=0)
    df = read_rest(spark, src, str(tmp_path / "r"), "id long", fetch, batch=3)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert list(pages(RestSource("http://x"), lambda *a: {"id": 1})) == [[{"id": 1}]]


def test_clustered_reset_describe_secondary(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    assert sinks.clustered(df, ["k"], 3).count() == 100
    sinks.secondary(df, [{"format": "csv", "path": str(tmp_path / "c")}, {"format": "parquet", "path": str(tmp_path / "p")}])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 100
    assert sinks.reset(spark, [str(tmp_path / "p"), str(tmp_path / "none")]) == [str(tmp_path / "p")]
    spark.sql("CREATE TABLE said (a int) USING parquet")
    sinks.describe(spark, "said", "it's here", {"a": "the a"}, {"x": "1"})
    assert spark.catalog.getTable("said").description == "it's here"
    spark.sql("DROP TABLE said")


def test_command_line(tmp_path, capsys):
    f = tmp_path / "c.yaml"
    f.write_text("name: x\nprimary_key: [a]\nmaterialization: {strategy: merge}\nmodel:\n  fields:\n    - {name: a, type: bigint}\n")
    assert main(["validate", str(f)]) == 0
    assert main(["ddl", str(f), "--table", "t", "--dialect", "postgres"]) == 0 and "PRIMARY KEY (a)" in capsys.readouterr().out
    f.write_text("name: x\nmaterialization: {strategy: merge}\n")
    assert main(["lint", str(f)]) == 1
