import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge as M
from millrace.operators import scd2 as V
from millrace.plans.processor import Processor
from millrace.sources import sinks
from millrace.sources.sinks import SchemaChangeNeedsMigration, SnapshotTable, align

CFG = V.Scd2(("id",), "at", ("status",))


def test_upsert_unites_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 8)], "id int, v string, w int")
    assert sorted((r.id, r.v, r.w) for r in M.upsert(old, new, ["id"]).collect()) == [(1, "a", None), (2, "B", 9), (3, "c", 8)]


def test_soft_delete_keeps_data_and_restores(spark):
    day1 = spark.createDataFrame([(1, "paid"), (2, "pending"), (3, "paid")], "id int, status string")
    now = F.lit("2024-01-02").cast("timestamp")
    two = M.reconcile(day1, day1.filter("id <> 2"), ["id"], M.SoftDelete(), now=now)
    gone = two.filter("id = 2").first()
    assert gone.status == "pending" and gone[M.DELETED] is True and gone[M.REASON] == "missing_from_snapshot"
    three = M.reconcile(two, day1, ["id"], M.SoftDelete(), now=now)
    assert three.filter(F.col(M.DELETED)).count() == 0 and three.count() == 3


def test_reconcile_guards_and_scopes(spark):
    old = spark.createDataFrame([(1, "GB"), (2, "GB"), (3, "FR")], "id int, country string")
    with pytest.raises(M.TooManyDeletes):
        M.reconcile(old, old.filter("id = 1"), ["id"], max_delete_ratio=0.5)
    out = M.reconcile(old, old.filter("id = 1"), ["id"], scope=F.expr("country = 'GB'"))
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_unknown_member_is_added_once(spark):
    df = M.with_surrogate_key(spark.createDataFrame([(1, "x")], "id int, name string"), ["id"])
    out = M.unknown_member(M.unknown_member(df, ["id"], lengths={"name": 3}), ["id"], lengths={"name": 3})
    assert sorted((r[M.SURROGATE], r.id, r.name) for r in out.collect())[0] == ("-1", -1, "Unk") and out.count() == 2


def _dim(df):
    return [(r.status, str(r.effective_from)[:10], str(r.effective_to)[:10], r.is_current, r._version, r._change_reason) for r in df.orderBy("id", "effective_from").collect()]


def _batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, status string, at string")


def test_scd2_late_arrival(spark):
    one = V.apply(None, _batch(spark, ("d1", "enquire", "2024-01-01")), CFG)
    two = V.apply(one, _batch(spark, ("d1", "serious", "2024-01-04")), CFG)
    late = V.apply(two, _batch(spark, ("d1", "notified", "2024-01-03")), CFG)
    assert _dim(late) == [
        ("enquire", "1900-01-01", "2024-01-03", False, 1, "initial_load"),
        ("notified", "2024-01-03", "2024-01-04", False, 2, "late_arrival"),
        ("serious", "2024-01-04", "9999-12-31", True, 3, "status"),
    ]
    assert _dim(V.apply(late, _batch(spark, ("d1", "notified", "2024-01-03"), ("d1", "serious", "2024-01-09")), CFG)) == _dim(late)


def test_scd2_detects_null_to_value(spark):
    one = V.apply(None, _batch(spark, ("a", None, "2024-01-01")), CFG)
    assert [x[0] for x in _dim(V.apply(one, _batch(spark, ("a", "x", "2024-02-01")), CFG))] == [None, "x"]


def test_scd2_invariants_hold_for_random_batches(spark):
    rng = random.Random(3)
    state = None
    for _ in range(4):
        rows = {(f"k{rng.randrange(3)}", f"2024-01-{rng.randrange(1, 28):02d}"): rng.choice("xyz") for _ in range(6)}
        before = {} if state is None else {(r.id, r.effective_from) for r in state.collect()}
        state = V.apply(state, _batch(spark, *[(k, s, d) for (k, d), s in rows.items()]), CFG)
        state = spark.createDataFrame(state.collect(), state.schema)
        after = {(r.id, r.effective_from) for r in state.collect()}
        assert set(before) <= after  # no start ever changes
        assert V.diagnose(state, CFG).count() == 0
        assert state.filter("is_current").groupBy("id").count().filter("count > 1").count() == 0


def test_scd2_repair(spark):
    rows = [("a", "2024-01-01", "2024-03-01", False), ("a", "2024-02-01", "9999-12-31", False)]
    df = spark.createDataFrame(rows, "id string, s string, e string, is_current boolean").select("id", F.col("s").cast("timestamp").alias("effective_from"), F.col("e").cast("timestamp").alias("effective_to"), "is_current")
    assert V.diagnose(df, CFG).count() == 2
    assert V.diagnose(V.repair(df, CFG), CFG).count() == 0


def test_snapshot_table_reads_itself_and_keeps_versions(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, "a")], "id int, v string"))
    t.change(lambda old: M.upsert(old, spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"]))
    assert t.version == 2 and sorted((r.id, r.v) for r in t.read().collect()) == [(1, "b"), (2, "c")]
    assert [(r.id, r.v) for r in t.read(1).collect()] == [(1, "a")]


def test_append_replaces_the_same_batch(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    b = spark.createDataFrame([(1, "k1")], "id int, b string")
    t.append(b, "b")
    t.append(b, "b")
    t.append(spark.createDataFrame([(2, "k2")], "id int, b string"), "b")
    assert sorted(r.id for r in t.read().collect()) == [1, 2]


def test_alignment_widens_and_refuses(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    a, b = align(old, spark.createDataFrame([(2, 5)], "id bigint, w int"))
    assert dict(a.dtypes) == {"id": "bigint", "v": "string", "w": "int"} and b.columns == a.columns
    with pytest.raises(SchemaChangeNeedsMigration):
        align(old, spark.createDataFrame([("x",)], "id string"))


def test_run_all_end_to_end(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0), (2, -1.0), (2, 7.0)], "id bigint, v double").write.parquet(src)
    c = {
        "name": "n", "dataset": "d", "source": {"path": src}, "primary_key": ["id"], "materialization": {"strategy": "merge", "sort_by": ["v"]},
        "model": {"fields": [{"name": "id", "type": "bigint"}, {"name": "v", "type": "double", "min": 0}]},
    }
    table, log = SnapshotTable(spark, str(tmp_path / "out")), sinks.RunLog(spark, str(tmp_path / "log"))
    counts = Processor(c, spark).run_all(table, str(tmp_path / "bad"), log)
    assert counts["good"] == 2 and counts["quarantined"] == 1
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, 5.0), (2, 7.0)]
    assert log.read().first().status == "success" and spark.read.parquet(str(tmp_path / "bad")).count() == 1


# -- tables as lists of folders ------------------------------------------------
def rows_of(t, version=None):
    df = t.read(version)
    return None if df is None else sorted(tuple(r) for r in df.collect())


def test_a_crash_before_the_version_is_listed_changes_nothing(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, "a")], "id int, v string"))

    def crash(*_):
        raise OSError("disk gone")

    with monkeypatch.context() as m:
        m.setattr(t.files, "create", crash)
        with pytest.raises(OSError):
            t.write(spark.createDataFrame([(2, "b")], "id int, v string"))
    assert t.version == 1 and rows_of(t) == [(1, "a")]
    (tmp_path / "t" / "_versions" / "000000000002").write_text('{"root": "data/x", "fol')  # cut off in the middle
    assert t.version == 1 and rows_of(t) == [(1, "a")]
    assert t.append(spark.createDataFrame([(3, "c")], "id int, v string")) == 3
    assert rows_of(t) == [(1, "a"), (3, "c")]


def test_one_of_two_writers_fails(spark, tmp_path):
    from millrace.sources.sinks import ConcurrentWrite

    one, two = (SnapshotTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.write(spark.createDataFrame([(1,)], "id int"))

    def late(old):
        one.append(spark.createDataFrame([(2,)], "id int"))
        return old.selectExpr("id + 10 AS id")

    with pytest.raises(ConcurrentWrite):
        two.change(late)
    assert rows_of(one) == [(1,), (2,)]


def test_append_writes_new_files_only(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), keep=3)
    for i in range(3):
        t.append(spark.createDataFrame([(i, f"b{i}")], "id int, b string"), "b")
    before = {p.root for p in t.parts(t.version)}
    t.append(spark.createDataFrame([(9, "b1"), (8, None)], "id int, b string"), "b")
    t.append(spark.createDataFrame([(7, None)], "id int, b string"), "b")
    after = {p.root for p in t.parts(t.version)}
    assert len(before & after) == 2  # only the folder of b1 was replaced
    assert sorted(map(str, rows_of(t))) == ["(0, 'b0')", "(2, 'b2')", "(7, None)", "(9, 'b1')"]
    assert sorted(map(str, rows_of(t, t.version - 1))) == ["(0, 'b0')", "(2, 'b2')", "(8, None)", "(9, 'b1')"]


def test_new_columns_and_wider_types_in_later_files(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1, "a")], "id int, v string"))
    t.append(spark.createDataFrame([(2**40, 1.5)], "id bigint, w double"))
    assert t.read().dtypes == [("id", "bigint"), ("v", "string"), ("w", "double")]
    assert sorted(rows_of(t), key=str) == sorted([(1, "a", None), (2**40, None, 1.5)], key=str)
    with pytest.raises(SchemaChangeNeedsMigration):
        t.append(spark.createDataFrame([("x",)], "id string"))
    assert t.version == 2


def test_only_touched_partitions_are_written(spark, tmp_path):
    from millrace.operators import merge as M

    t = SnapshotTable(spark, str(tmp_path / "t"), ["p"], keep=2)
    t.write(spark.createDataFrame([(i, f"p/{i % 3}" if i % 4 else None, "old") for i in range(12)], "id int, p string, v string"))
    first = {p.folder: p.root for p in t.parts(1)}
    batch = spark.createDataFrame([(1, "p/1", "new"), (100, None, "new")], "id int, p string, v string")
    t.merge_partitions(batch, lambda old, new: M.upsert(old.select("id", "p", "v"), new, ["id"]))
    second = {p.folder: p.root for p in t.parts(2)}
    assert {f for f in second if second[f] != first.get(f)} == {"p=p%2F1", "p=__HIVE_DEFAULT_PARTITION__"}
    got = {r.id: (r.p, r.v) for r in t.read().collect()}
    assert got[1] == ("p/1", "new") and got[100] == (None, "new") and got[5] == ("p/2", "old") and len(got) == 13
    t.merge_partitions(batch.filter("id = 1"), lambda old, new: old.filter("false"))  # a partition can become empty
    assert not [p for p in t.parts(3) if p.folder == "p=p%2F1"] and t.read().count() == len([i for i in got if got[i][0] != "p/1"])


def test_old_versions_go(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), keep=2)
    for i in range(5):
        t.write(spark.createDataFrame([(i,)], "id int"))
    assert rows_of(t) == [(4,)] and rows_of(t, 4) == [(3,)] and rows_of(t, 3) is None
    assert len(t.files.names(str(tmp_path / "t" / "data"))) == 2


def test_a_contract_has_further_targets_and_compaction(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    contract = {
        "name": "c", "source": {"path": str(tmp_path / "in")}, "lineage": {"enabled": False},
        "materialization": {"strategy": "append", "secondary": [{"format": "json", "path": str(tmp_path / "copy")}], "compact_files": 1, "compact_after": 2},
    }
    t = SnapshotTable(spark, str(tmp_path / "t"))
    for n in (1, 2, 1):
        Processor(contract, spark).run_all(t)
        assert len(t.parts(t.version)) == n
    assert t.read().count() == 15 and spark.read.json(str(tmp_path / "copy")).count() == 5
    spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "in"))


def test_a_contract_reprocesses_by_its_policy(spark, tmp_path):
    from millrace.plans.contract import ContractError

    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "id int, p int")
    for policy, rows in (("overwrite_partition", 4), ("overwrite_partition_safe", None), ("fail", None), ("append", 7), ("overwrite_all", 1), ("nonsense", None)):
        p = Processor({"name": "c", "lineage": {"enabled": False}, "materialization": {"strategy": "append", "reprocess_policy": policy}}, spark)
        t = SnapshotTable(spark, str(tmp_path / policy), ["p"])
        p.materialize(df, t)
        if rows is None:
            with pytest.raises(ContractError):
                p.reprocess(df.filter("id = 1"), t)
            assert t.read().count() == 6
        else:
            p.reprocess(df.filter("id = 1"), t)
            assert t.read().count() == rows


def test_ranges_of_a_clustered_table_follow_its_rows_and_bytes(spark, monkeypatch):
    ranges = lambda df, n: sinks.clustered(df, ["k"], n).groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    many = spark.range(3_500_000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("k"))
    for df, rows in ((many, 3_500_000), (many.limit(100), 100), (many.limit(0), 0)):
        got = ranges(df, 2)
        assert sum(r.n for r in got) == rows and all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False))
        assert len(got) == min(rows, 4 if rows > 100 else 2)
    monkeypatch.setattr(sinks, "RANGE_BYTES", 100_000)
    wide = spark.range(100).select(F.col("id").alias("k"), F.array(F.repeat(F.lit("x"), 10_000)).alias("v"))
    assert len(ranges(wide, 2)) >= 8
    assert len(ranges(wide.withColumn("k", F.lit(1)), 2)) == 1  # a key isn't split
