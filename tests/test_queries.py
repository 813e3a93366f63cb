import os
import sys

import duckdb
import pytest

from millrace.plans import coverage_queries  # noqa: F401 - registers its queries
from millrace.plans import queries as Q
from millrace.plans import table_queries  # noqa: F401 - registers its queries

sys.path.insert(0, os.path.dirname(__file__))
from oracle import FOLDER, rows, same  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = Q.QUERIES["i_boundary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_orderstatus" in plan.replace("IsNotNull(o_orderdate), ", "").replace("IsNotNull(o_orderstatus), ", "") or "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan


def in_files(spark, folder, tmp_path, **parts):
    """A folder whose named tables lie in some files each, none if zero."""
    for name, n in parts.items():
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.repartition(n) if n else df.limit(0)).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("files", [3, 0])
@pytest.mark.parametrize("name,source", [("src_text_conventions", "orders"), ("src_csv_dialect", "supplier"), ("src_decimal_comma", "supplier")])
def test_text_of_a_table_in_several_files(spark, tmp_path, name, source, files):
    got = Q.QUERIES[name](spark, in_files(spark, FOLDER, tmp_path, **{source: files})).toArrow()
    want = duckdb.sql(Q.ORACLES[name].replace(f"FROM {source}", f"FROM '{FOLDER}/{source}.parquet'")).to_arrow_table()
    assert rows(got) == (rows(want) if files else (rows(want)[0], []))


@pytest.mark.parametrize("days,rows_a_day", [(9, 210_000), (9, 50_000), (9, 49_999), (3, 10), (0, 0)])
def test_anomaly_of_many_and_few_events(spark, tmp_path, days, rows_a_day):
    duckdb.sql(f"COPY (SELECT TIMESTAMP '2024-01-28' - INTERVAL 1 DAY * (i % {max(1, days)}) AS ts FROM range({days * rows_a_day}) r(i)) TO '{tmp_path}/events.parquet'")
    same(spark, Q.QUERIES["o_anomaly_average"], Q.ORACLES["o_anomaly_average"], str(tmp_path))
