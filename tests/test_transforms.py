import pytest
from pyspark.sql import Row

from millrace.functions.expressions import bind, json_path
from millrace.operators.transforms import Context, apply


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_unknown_transform_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown transform"):
        apply(spark.range(1), [{"nope": {}}], Context())


def test_rename_skips_absent(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert apply(df, [{"rename": {"a": "b", "x": "y"}}], Context()).columns == ["b"]


def test_split_takes_delimiter_literally(spark):
    df = spark.createDataFrame([("a|b.c",)], "v string")
    assert rows(apply(df, [{"split": {"field": "v", "delimiter": "|"}}], Context())) == [('["a","b.c"]',)]


def test_explode_keeps_empty_and_null(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id int, v array<string>")
    out = apply(df, [{"explode": {"field": "v"}}], Context())
    assert sorted((r.id, r.v or "") for r in out.collect()) == [(1, "x"), (1, "y"), (2, ""), (3, "")]


def test_dedup_latest_and_blank_keys(spark):
    data = [(None, "2026-01-01", f"n{i}") for i in range(5)] + [("1", "2026-01-01", "old"), ("1", "2026-06-01", "new"), ("2", "2026-01-01", "only")]
    df = spark.createDataFrame(data, "trip_id string, updated_at string, v string")
    out = apply(df, [{"deduplicate": {"on": "trip_id", "sort_by": "updated_at"}}], Context())
    assert sorted(r.v for r in out.collect()) == ["n0", "n1", "n2", "n3", "n4", "new", "only"]


def test_dedup_needs_an_order(spark):
    with pytest.raises(ValueError, match="sort_by"):
        apply(spark.range(2), [{"deduplicate": {"on": "id"}}], Context())


def test_pivot_first_skips_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", 5), (1, "b", 7)], "id int, k string, v int")
    out = apply(df, [{"pivot": {"id_vars": ["id"], "pivot_col": "k", "values": ["a", "b", "c"], "value_cols": ["v"]}}], Context())
    assert rows(out) == [(1, 5, 7, None)]


def test_date_range_explode_guards_order(spark):
    df = spark.createDataFrame([(1, "20240101", "2024-01-03"), (2, "2024-01-05", "2024-01-01"), (3, "2024-01-09", None)], "id int, a string, b string")
    out = apply(df, [{"date_range_explode": {"start_col": "a", "end_col": "b", "output": "d", "today": "2024-01-10"}}], Context())
    assert [(r.id, str(r.d)) for r in out.orderBy("id", "d").collect()] == [(1, "2024-01-01"), (1, "2024-01-02"), (1, "2024-01-03"), (3, "2024-01-09"), (3, "2024-01-10")]


def test_bucket_first_fit_and_default(spark):
    df = spark.createDataFrame([(1,), (5,), (50,), (None,)], "v int")
    out = apply(df, [{"bucket": {"source": "v", "field": "b", "bins": [{"lt": 3, "label": "low"}, {"gte": 3, "lte": 10, "label": "mid"}]}}], Context())
    assert sorted((r.v or 0, r.b or "") for r in out.collect()) == [(0, ""), (1, "low"), (5, "mid"), (50, "")]


def test_sql_binds_tables_not_literals(spark):
    df = spark.createDataFrame([("source", 1)], "source string, n int")
    out = apply(df, [{"sql": "SELECT 'source {x}' AS a, s.source, n FROM source s"}], Context())
    assert rows(out) == [("source {x}", "source", 1)]


def test_bind_leaves_dotted_names():
    text, used = bind("SELECT * FROM db.source JOIN source ON 1 = 1", {"source": None})
    assert "db.source" in text and "{t_source} AS `source`" in text and list(used) == ["t_source"]


def test_json_path_quoted_keys():
    assert json_path('$."my key".b') == "$['my key'].b"


def test_join_full_with_defaults(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    right = spark.createDataFrame([(2, 20.0), (3, 30.0)], "k int, rate double")
    out = apply(left, [{"join": {"reference": "r", "on": "id", "key": "k", "type": "full", "fields": ["rate"], "defaults": {"rate": 0.0}}}], Context({"r": right}))
    assert sorted((r.id or 0, r.rate) for r in out.collect()) == [(0, 30.0), (1, 0.0), (2, 20.0)]


def test_rollup_traces_keys(spark):
    df = spark.createDataFrame([Row(g="x", k=2), Row(g="x", k=1), Row(g="x", k=1)])
    out = apply(df, [{"rollup": {"group_by": ["g"], "aggregations": {"n": "count(*)"}, "keys": "k", "rollup_keys_count_column": "c"}}], Context())
    assert rows(out) == [("x", 3, [1, 2], 2)]
