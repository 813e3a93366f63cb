import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.rules import READ_ERROR
from millrace.operators.schema import Field
from millrace.sources import incremental as I
from millrace.sources.files import SourceConfig, existing_paths, normalise_cdc, partition_paths, read, records, reprocess


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_text(text, encoding=encoding)
    return str(p)


def test_csv_dialect(spark, tmp_path):
    p = put(tmp_path, "a.csv", "generated today\nid;name\n1;'x;y'\n2;N/A\n")
    c = SourceConfig(p, "csv", options={"delimiter": ";", "quote_char": "'", "skip_rows": 1, "null_values": ["N/A", "-"]})
    assert sorted((r.id, r.name) for r in read(spark, c).collect()) == [("1", "x;y"), ("2", None)]


def test_json_array_and_lines_agree(spark, tmp_path):
    fields = [Field("id", "bigint"), Field("amount", "double")]
    a = put(tmp_path, "a.json", '[{"id": 1, "amount": "n/a"},\n {"id": 2, "amount": 3.5}]')
    b = put(tmp_path, "b.json", '{"id": 1, "amount": "n/a"}\n{"id": 2, "amount": 3.5}\n')
    one, two = (sorted((r.id, r.amount) for r in read(spark, SourceConfig(p, "json", fields=fields)).collect()) for p in (a, b))
    assert one == two == [("1", "n/a"), ("2", "3.5")]


def test_unreadable_json_is_a_row_error(spark, tmp_path):
    p = put(tmp_path, "a.json", '{"id": 1}\n{oops\n')
    out = read(spark, SourceConfig(p, "json", fields=[Field("id", "bigint")], options={"multiline": False})).collect()
    assert [bool(r[READ_ERROR]) for r in sorted(out, key=lambda r: r.id or "~")] == [False, True]


def test_fixed_width(spark, tmp_path):
    p = put(tmp_path, "f.txt", "HDR 2024\n000001Ann                 GB\n000002Bo\nTRL 2\n")
    c = SourceConfig(p, "fixed_width", options={"layout": [("id", 6), ("name", 20), ("country", 2)], "skip_prefixes": ["HDR", "TRL"]})
    out = {r.id: r for r in read(spark, c).collect()}
    assert out["000001"].name == "Ann" and out["000001"].country == "GB" and out["000001"][READ_ERROR] is None
    assert "shorter" in out["000002"][READ_ERROR]


def test_xml_rows_with_nested_json(spark, tmp_path):
    p = put(tmp_path, "o.xml", "<orders><order><id>1</id><lines><line><sku>a</sku></line><line><sku>b</sku></line></lines></order><order><id>2</id></order></orders>")
    out = read(spark, SourceConfig(p, "xml", options={"row_tag": "order"})).orderBy("id").collect()
    assert [r.id for r in out] == ["1", "2"] and '"sku":"a"' in out[0].lines


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "id,v\n1,a\n2,b\n")
        z.writestr("skip.txt", "no")
    c = SourceConfig(str(tmp_path / "a.zip"), "zip", fields=[Field("id"), Field("v")], options={"member_pattern": r"\.csv$", "inner": "csv"})
    assert sorted((r.id, r.v) for r in read(spark, c).collect()) == [("1", "a"), ("2", "b")]


def test_text_conventions(spark, tmp_path):
    p = put(tmp_path, "a.csv", 'amount,on,ok\n"1.234,50",31/12/2024,ja\n')
    fields = [Field("amount", "double"), Field("on", "date"), Field("ok", "boolean")]
    c = SourceConfig(p, "csv", fields=fields, text={"decimal_comma": True, "date_formats": {"on": "dd/MM/yyyy"}, "booleans": {"true": ["ja"], "false": ["nein"]}})
    assert tuple(read(spark, c).first()) == ("1234.50", "2024-12-31", "true")


def test_missing_integrations_name_themselves(spark):
    with pytest.raises(NotImplementedError, match="mongodb"):
        read(spark, SourceConfig("x", "mongodb"))


def test_partitioned_landing(spark, tmp_path):
    for day in ("01", "03"):
        spark.range(2).write.parquet(str(tmp_path / f"2024/01/{day}"))
    paths = partition_paths(str(tmp_path), "%Y/%m/%d", datetime(2024, 1, 1), datetime(2024, 1, 3))
    present, missing = existing_paths(spark, paths)
    assert [p[-2:] for p in present] == ["01", "03"] and [p[-2:] for p in missing] == ["02"]


def test_reprocess_range_includes_the_last_day(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00",), ("2024-01-02 23:59:59",), ("2024-01-03 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert reprocess(df, "t", "2024-01-01", "2024-01-02").count() == 2


def test_cdc_codes(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "id int, `__$operation` int")
    assert sorted((r.id, r["_dc_cdc_op"]) for r in normalise_cdc(df).collect()) == [(1, "delete"), (2, "insert"), (4, "update")]


def test_records_have_declared_types(spark):
    assert records(spark, [{"a": 1}, {"b": "x"}], [Field("a", "bigint"), Field("b", "string")]).dtypes == [("a", "bigint"), ("b", "string")]


def test_lookback_units():
    now = datetime(2024, 3, 31, 12)
    assert I.lookback("7 days", now) == datetime(2024, 3, 24, 12) and I.lookback("1 month", now) == datetime(2024, 2, 29, 12) and I.lookback(60, now) == datetime(2024, 3, 31, 11, 59)


def test_date_parts_are_pruned_by_column_bounds(spark, tmp_path):
    df = spark.range(400).select(F.date_add(F.lit("2023-06-01").cast("date"), F.col("id").cast("int")).alias("d")).withColumns({"y": F.year("d"), "m": F.month("d"), "dd": F.dayofmonth("d")})
    b = I.date_range("d", datetime(2023, 12, 30), datetime(2024, 2, 2), ("y", "m", "dd"))
    assert b.apply(df).agg(F.min("d"), F.max("d"), F.count("*")).first() == (datetime(2023, 12, 30).date(), datetime(2024, 2, 2).date(), 35)
    df.write.partitionBy("y", "m", "dd").parquet(str(tmp_path / "p"))
    plan = b.apply(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "y#" in plan.split("PartitionFilters")[1][:200]


def test_max_target_is_strict_and_guards(spark):
    b = I.max_target(spark.createDataFrame([(5,)], "k int"), "k", datetime(2024, 1, 1))
    assert b.start == 5 and b.start_excluded
    with pytest.raises(ValueError):
        I.resolve({"strategy": "pipeline_log", "type": "table", "dataset": "x"}, datetime(2024, 1, 1))


def test_pipeline_log_skips_failed_runs(spark):
    rows = [("d", "success", "run", datetime(2024, 1, 1)), ("d", "failed", "run", datetime(2024, 1, 9)), ("d", "success", "no_new_data", datetime(2024, 1, 8))]
    runs = spark.createDataFrame(rows, "dataset string, status string, stage string, max_source_mtime timestamp")
    assert I.pipeline_log(runs, "d").start == datetime(2024, 1, 1)


def test_manifest(spark, tmp_path):
    m = I.Manifest(spark, str(tmp_path / "done"))
    m.add(["a"])
    assert m.pending(["a", "b"]) == ["b"]
