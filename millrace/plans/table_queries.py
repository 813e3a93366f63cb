"""Registered queries that write and read again: formats, snapshot tables, partitions, quarantine and a stream."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..operators import fleet, governance as G, merge as M, profile as P, rules as R
from ..operators.schema import Field, Policy, enforce, flatten
from ..sources import incremental, sinks
from ..sources.files import SourceConfig, read
from ..streaming.sink import StreamSink, file_stream
from .processor import Processor
from .queries import query, table


def folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can write; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex[:12]}"

    def clean() -> None:
        try:
            sinks.Files(spark).delete(path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    atexit.register(clean)
    return path


NATION = [Field("n_nationkey", "int"), Field("n_name", "string"), Field("n_regionkey", "int")]
_NATION_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nation(df: DataFrame) -> DataFrame:
    return enforce(df, NATION, Policy(unknown_fields="drop"))[0].select("n_nationkey", "n_name", "n_regionkey")


def _round_trip(format: str, options: dict, write_options: dict | None = None, write_format: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = folder(spark)
        sinks.write_files(table(spark, sf, "nation"), path, write_format or format, options=write_options)
        return _nation(read(spark, SourceConfig(path, format, options=options, fields=NATION if format == "json" else [])))

    query(_NATION_SQL, f"src_{format}")(run)


_round_trip("parquet", {})
_round_trip("orc", {})
_round_trip("csv", {"delimiter": ";"}, {"sep": ";"})
_round_trip("json", {})
_round_trip("xml", {"row_tag": "row"}, {"rowTag": "row"})


@query(_NATION_SQL)
def src_fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    line = F.concat(F.lpad(col("n_nationkey").cast("string"), 4, "0"), F.rpad("n_name", 30, " "), F.lpad(col("n_regionkey").cast("string"), 4, "0"))
    table(spark, sf, "nation").select(line.alias("value")).write.text(path)
    return _nation(read(spark, SourceConfig(path, "fixed_width", options={"layout": [("n_nationkey", 4), ("n_name", 30), ("n_regionkey", 4)]})))


@query("SELECT c_custkey, c_name AS c_name, c_nationkey AS where_nation, c_mktsegment AS where_more_segment FROM customer")
def t_flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    nested = F.struct(col("c_nationkey").alias("nation"), F.struct(col("c_mktsegment").alias("segment")).alias("more")).alias("where")
    return flatten(table(spark, sf, "customer").select("c_custkey", "c_name", nested))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def m_append_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch twice, and another one: each is there once."""
    t = sinks.SnapshotTable(spark, folder(spark))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(col("o_orderstatus") == "F", "b1").otherwise("b2").alias("batch"))
    for b in ("b1", "b1", "b2"):
        t.append(rows.filter(col("batch") == b), "batch")
    return t.read().select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 0.0 ELSE s_acctbal END::DOUBLE AS s_acctbal, s_nationkey FROM supplier")
def m_overwrite_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    sinks.overwrite_partitions(s, path, ["s_nationkey"])
    sinks.overwrite_partitions(s.filter("s_nationkey < 5").withColumn("s_acctbal", F.lit(0.0)), path, ["s_nationkey"])
    return spark.read.parquet(path)


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey IN (1, 2) THEN 'new' ELSE 'old' END AS state FROM supplier WHERE s_nationkey IN (1, 2)")
def m_merge_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Only the partitions that a batch touches are read and made anew."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.lit("old").alias("state"))
    batch = s.filter("s_nationkey IN (1, 2)").withColumn("state", F.lit("new"))
    return M.merge_partitions(s, batch, ["s_nationkey"], lambda a, b: M.upsert(a, b, ["s_suppkey"]))[0]


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'late' ELSE 'first' END AS came FROM customer")
def m_reprocess_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that were rejected pass a looser rule later and are marked in the quarantine."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    good, bad = R.split(R.evaluate(c, [R.in_range("c_acctbal", 0)]))
    path = folder(spark)
    sinks.quarantine(bad).write.parquet(path)
    rerun = lambda df: R.split(R.evaluate(df, [R.in_range("c_acctbal", -1_000_000)]))
    now, marked = sinks.reprocess_quarantine(spark.read.parquet(path), rerun, ["c_custkey"])
    late = now.join(marked.filter("quarantine_reprocessed").select("c_custkey"), "c_custkey", "left_semi")
    return good.select("c_custkey", F.lit("first").alias("came")).unionByName(late.select("c_custkey", F.lit("late").alias("came")))


@query("SELECT substr(sha256(c_custkey::VARCHAR), 1, 16) AS _sk, c_custkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '' END AS c_mktsegment FROM customer UNION ALL SELECT '-1', -1, 'Unknown'")
def m_scd1_contract(spark: SparkSession, sf: str) -> DataFrame:
    contract = {"name": "customers", "primary_key": ["c_custkey"], "lineage": {"enabled": False}, "materialization": {"strategy": "scd1", "unknown_member": True}}
    p, t = Processor(contract, spark), sinks.SnapshotTable(spark, folder(spark))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    for batch in (c, c.withColumn("c_mktsegment", F.concat("c_mktsegment", F.when(col("c_custkey") % 2 == 0, "+").otherwise("")))):
        p.materialize(p.run(batch).good, t)
    return t.read()


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def s_stream_to_table(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream: micro-batches, the latest of each user, into a merged table."""
    base, events = folder(spark), table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    sinks.write_files(events, f"{base}/in")  # a stream reads a folder
    stream = file_stream(spark, f"{base}/in", "parquet", events.schema)
    t = sinks.SnapshotTable(spark, f"{base}/t")
    contract = {"name": "events", "primary_key": ["user_id"], "lineage": {"enabled": False}, "materialization": {"strategy": "merge"}}
    StreamSink(Processor(contract, spark), stream, t, f"{base}/checkpoint", keys=["user_id"], order=["ts", "event_id"]).run()
    return t.read().select("user_id", "event_id", "event_type")


@query("SELECT n_nationkey, 'r1' AS _up_run_id, 'r2' AS _dc_run_id FROM nation")
def l_upstream_lineage(spark: SparkSession, sf: str) -> DataFrame:
    one = G.lineage(table(spark, sf, "nation").select("n_nationkey"), G.RunInfo("r1", "bronze"))
    return G.lineage(one, G.RunInfo("r2", "silver"), upstream_prefix="_up_").select("n_nationkey", "_up_run_id", "_dc_run_id")


@query("SELECT DISTINCT c_custkey, c_name FROM customer")
def v_vault(spark: SparkSession, sf: str) -> DataFrame:
    return G.vault(table(spark, sf, "customer"), ["c_custkey"], ["c_name"])


@query("SELECT event_type AS dataset, max(ts) AS last_success, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' AS passed FROM events GROUP BY 1")
def o_fleet_freshness(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(col("event_type").alias("dataset"), F.lit("success").alias("status"), col("ts").alias("timestamp"))
    out = fleet.fleet_freshness(runs, {}, F.lit("2024-01-31 12:00:00"), 24.0)
    return out.select("dataset", col("last_success").cast("timestamp_ntz").alias("last_success"), "passed")


@query("SELECT 'duplicate_keys' AS kind, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def g_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = P.findings(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(f["kind"], f["count"]) for f in found], "kind string, n bigint")


@query("SELECT count(*) AS bad FROM part")
def q_unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Undeclared fields reject every row where the policy says so."""
    df, errors = enforce(table(spark, sf, "part"), [Field("p_partkey", "bigint"), Field("p_name", "string")], Policy(unknown_fields="quarantine"))
    return R.split(R.evaluate(df, [], errors))[1].agg(F.count("*").alias("bad"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def i_max_target(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime

    o = table(spark, sf, "orders")
    return incremental.max_target(o.filter("o_orderstatus = 'F'"), "o_orderdate", datetime(2024, 1, 1)).apply(o).select("o_orderkey")
