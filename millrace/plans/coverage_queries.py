"""Registered queries for the readers, policies, rules and guards that no other query exercises."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..operators import dataset_rules as D
from ..operators import erasure as E
from ..operators import fleet, governance as G, merge as M, profile as P, rules as R, scd2 as V, slo as O
from ..operators.schema import Field, cast_all_text, enforce, flatten_json, struct_drift
from ..operators.transforms import Context, apply
from ..sources import files, incremental, sinks
from ..sources.files import SourceConfig, read
from ..streaming.sink import StreamSink, decode, file_stream, simulate
from ..operators.generate import synthesize
from .authoring import create_table
from .contract import load
from .pipeline import downstream, upstream_fresh
from .processor import Processor
from .queries import query, table
from .table_queries import folder

PLAIN = {"lineage": {"enabled": False}}
SUPPLIER = [Field("s_suppkey", "bigint"), Field("s_acctbal", "double"), Field("s_nationkey", "int")]


def _lines(spark: SparkSession, sf: str, path: str, line, head: list[str] = (), name: str = "supplier") -> None:  # noqa: ANN001
    """Text files with a line for every row of a table; each begins with the head lines."""
    rows = table(spark, sf, name).select(line.alias("value"))
    if rows.isEmpty():
        rows = spark.createDataFrame([("\n".join(head),)], "value string").filter(F.lit(bool(head)))
    elif head:  # ids count from zero in the 33 low bits of each partition, and a partition is a file
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        rows = rows.withColumn("value", F.when(first, F.concat(F.lit("\n".join([*head, ""])), "value")).otherwise(F.col("value")))
    rows.write.option("maxRecordsPerFile", 0).text(path)


# -- readers --------------------------------------------------------------------
@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def src_csv_dialect(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows before the header, another quote, two words for null."""
    path = folder(spark)
    word = F.when(col("s_suppkey") % 3 != 0, col("s_nationkey").cast("string")).when(col("s_suppkey") % 2 == 0, "n/a").otherwise("-")
    _lines(spark, sf, path, F.concat_ws(";", "s_suppkey", F.concat(F.lit("'"), "s_name", F.lit("'")), word), ["made by hand", "", "s_suppkey;s_name;s_nationkey"])
    df = read(spark, SourceConfig(path, "csv", options={"delimiter": ";", "quote_char": "'", "skip_rows": 2, "null_values": ["n/a", "-"]}))
    return df.select(col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", col("s_nationkey").cast("int").alias("s_nationkey"))


@query("SELECT s_suppkey, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def src_decimal_comma(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    shown = F.translate(F.format_string("%,.2f", col("s_acctbal")), ",.", ".,")
    _lines(spark, sf, path, F.concat_ws(";", "s_suppkey", shown), ["s_suppkey;s_acctbal"])
    df = read(spark, SourceConfig(path, "csv", options={"delimiter": ";"}, fields=SUPPLIER, text={"decimal_comma": True}))
    return enforce(df, SUPPLIER[:2])[0].select("s_suppkey", "s_acctbal")


@query("SELECT o_orderkey, o_orderdate::DATE AS d, o_orderstatus = 'O' AS open FROM orders")
def src_text_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """Padded texts, dates as dd/MM/yyyy and words for true and false."""
    path = folder(spark)
    line = F.concat_ws("|", "o_orderkey", F.concat(F.lit("  "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" ")), F.when(col("o_orderstatus") == "O", "Yes").otherwise("no"))
    _lines(spark, sf, path, line, ["o_orderkey|d|open"], "orders")
    fields = [Field("o_orderkey", "bigint"), Field("d", "date"), Field("open", "boolean")]
    text = {"trim": True, "date_formats": {"d": "dd/MM/yyyy"}, "booleans": {"true": ["yes"], "false": ["no"]}}
    return enforce(read(spark, SourceConfig(path, "csv", options={"delimiter": "|"}, fields=fields, text=text)), fields)[0].select("o_orderkey", "d", "open")


@query("SELECT n_nationkey, n_name FROM nation")
def src_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON array in a file."""
    path = folder(spark)
    one = table(spark, sf, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    one.coalesce(1).write.text(path)
    return read(spark, SourceConfig(path, "json", fields=[Field("n_nationkey", "int"), Field("n_name", "string")])).select(col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT n_nationkey, n_name FROM nation")
def src_gzip(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(2).write.option("header", True).option("compression", "gzip").csv(path)
    return read(spark, SourceConfig(path, "csv")).select(col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT n_nationkey, n_name FROM nation")
def src_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Two members of an archive; a third doesn't match."""
    import io
    import zipfile

    path, rows = folder(spark), table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # a table of 25 rows
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for k, part in enumerate((rows[:10], rows[10:])):
            z.writestr(f"part{k}.csv", "n_nationkey,n_name\n" + "".join(f"{r[0]},{r[1]}\n" for r in part))
        z.writestr("readme.txt", "not data")
    fs = sinks.Files(spark)
    p, h = fs._at(f"{path}/a.zip")
    stream = h.create(p, False)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    fields = [Field("n_nationkey", "int"), Field("n_name", "string")]
    df = read(spark, SourceConfig(f"{path}/a.zip", "zip", options={"member_pattern": r"\.csv$", "inner": "csv"}, fields=fields))
    return df.select(col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT p_partkey, p_brand FROM part")
def src_catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").select("p_partkey", "p_brand").createOrReplaceTempView("millrace_part")
    return read(spark, SourceConfig("", table="millrace_part"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 4 = 1 THEN 'delete' WHEN r_regionkey % 4 = 2 THEN 'insert' ELSE 'update' END AS _dc_cdc_op FROM region WHERE r_regionkey % 4 <> 3")
def src_native_cdc(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of a change table as words; images from before a change go."""
    code = F.when(col("r_regionkey") % 4 == 0, 4).otherwise(col("r_regionkey") % 4)
    return files.normalise_cdc(table(spark, sf, "region").select("r_regionkey", code.alias("__$operation")))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey < 10")
def src_globs(spark: SparkSession, sf: str) -> DataFrame:
    """Folders n=0 to n=9 by a pattern, present and missing ones told apart."""
    path = folder(spark)
    table(spark, sf, "supplier").select("s_suppkey", F.format_string("%02d", col("s_nationkey")).alias("n")).write.partitionBy("n").parquet(path)
    present, _ = files.existing_paths(spark, [f"{path}/n=0*", f"{path}/n=9*"])
    return read(spark, SourceConfig(present, "parquet")).select("s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-20'")
def src_dated_landing(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of days from the first to the twentieth; days without a folder are skipped."""
    path = folder(spark)
    o = table(spark, sf, "orders").filter("o_orderdate >= '1995-02-20' AND o_orderdate < '1995-04-01'")
    o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day")).write.partitionBy("day").parquet(path)
    days = files.partition_paths(path, "day=%Y%m%d", datetime(1995, 3, 1), datetime(1995, 3, 20))
    found = files.read_partitions(spark, SourceConfig(path, "parquet"), days)
    return spark.createDataFrame([], "o_orderkey bigint") if found is None else found.select("o_orderkey")


@query("SELECT s_suppkey, s_nationkey::VARCHAR AS nation FROM supplier")
def src_path_keys(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    table(spark, sf, "supplier").select("s_suppkey", col("s_nationkey").alias("nation")).write.partitionBy("nation").json(path)
    lines = spark.read.schema("s_suppkey bigint").option("recursiveFileLookup", True).json(path)
    return files.with_path_keys(lines, ["nation"])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1994-06-01' AND DATE '1994-06-30'")
def src_reprocess_range(spark: SparkSession, sf: str) -> DataFrame:
    """Both days are whole."""
    return files.reprocess(table(spark, sf, "orders"), "o_orderdate", "1994-06-01", "1994-06-30").select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def src_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = [r.asDict() for r in table(spark, sf, "nation").filter("n_regionkey = 1").collect()]  # rows in memory are the source
    return files.records(spark, rows, [Field("n_nationkey", "int"), Field("n_name", "string")])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def src_link_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A link read by the contract, filtered, then cut to two columns."""
    contract = PLAIN | {
        "name": "c",
        "links": [{"name": "nation", "path": f"{sf}/nation.parquet", "filter": "n_regionkey < 3", "columns": ["n_nationkey", "n_name"], "broadcast": True}],
        "transformations": [{"join": {"reference": "nation", "on": "c_nationkey", "key": "n_nationkey", "type": "left", "fields": ["n_name"]}}],
    }
    return Processor(contract, spark).run(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).good.select("c_custkey", "n_name")


@query("SELECT 0 AS source, 0 AS good, 0 AS stored, 'no_new_data' AS stage")
def src_empty(spark: SparkSession, sf: str) -> DataFrame:
    """An empty source is a run without new data, and stores nothing."""
    path = folder(spark)
    table(spark, sf, "nation").limit(0).write.parquet(f"{path}/in")
    t, log = sinks.SnapshotTable(spark, f"{path}/t"), sinks.RunLog(spark, f"{path}/log")
    n = Processor(PLAIN | {"name": "c", "source": {"path": f"{path}/in"}}, spark).run_all(t, log=log)
    return spark.createDataFrame([(n["source"], n["good"], t.version, log.read().first()["stage"])], "source int, good int, stored int, stage string")


@query("SELECT count(*) FILTER (event_id % 7 <> 0) AS good, count(*) FILTER (event_id % 7 = 0) AS bad FROM events")
def rule_unreadable_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that can't be read are rejected with their reason, whatever the rules."""
    sent = table(spark, sf, "events").select(col("event_id").alias("offset"), F.lit(0).alias("partition"), F.when(col("event_id") % 7 != 0, F.lit('{"k": 1}')).otherwise("{broken").alias("value"))
    n = Processor(PLAIN | {"name": "c"}, spark).run(decode(sent, [Field("k", "string")])).counts()
    return spark.createDataFrame([(n["good"], n["quarantined"])], "good bigint, bad bigint")


@query("SELECT event_id, 'Unreadable record: invalid JSON (partition 3 offset ' || event_id || '): {broken' AS reason FROM events WHERE event_id % 7 = 0")
def s_decode_poison(spark: SparkSession, sf: str) -> DataFrame:
    sent = table(spark, sf, "events").select(col("event_id").alias("offset"), F.lit(3).alias("partition"), F.when(col("event_id") % 7 != 0, col("props")).otherwise("{broken").alias("value"))
    out = decode(sent, [Field("k", "string")]).filter(col(R.READ_ERROR).isNotNull())
    return out.select(col("offset").alias("event_id"), col(R.READ_ERROR).alias("reason"))


# -- schema ---------------------------------------------------------------------
@query("SELECT p_partkey::BIGINT AS p_partkey, p_size::INT AS p_size, p_brand FROM part")
def t_cast_all_text(spark: SparkSession, sf: str) -> DataFrame:
    """A frame that is all text takes its declared types."""
    text = table(spark, sf, "part").select(col("p_partkey").cast("string").alias("p_partkey"), col("p_size").cast("string").alias("p_size"), "p_brand")
    return cast_all_text(text, [Field("p_partkey", "bigint"), Field("p_size", "int"), Field("p_brand", "string")])


@query("SELECT s_suppkey, s_nationkey, NULL::VARCHAR AS note FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT s_suppkey + 10000000000, s_nationkey, 'late' FROM supplier WHERE s_nationkey >= 5")
def m_align_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Later files have wider keys and one more column."""
    t, s = sinks.SnapshotTable(spark, folder(spark)), table(spark, sf, "supplier")
    t.append(s.filter("s_nationkey < 5").select(col("s_suppkey").cast("int").alias("s_suppkey"), "s_nationkey"))
    t.append(s.filter("s_nationkey >= 5").select((col("s_suppkey") + F.lit(10_000_000_000)).alias("s_suppkey"), "s_nationkey", F.lit("late").alias("note")))
    return t.read().select("s_suppkey", "s_nationkey", "note")


@query("SELECT 'id string can''t become int' AS refused, 1 AS versions")
def m_refuse_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    t = sinks.SnapshotTable(spark, folder(spark))
    t.append(table(spark, sf, "nation").select(col("n_name").alias("id")))
    try:
        t.append(table(spark, sf, "nation").select(F.lit(datetime(2024, 1, 1)).alias("id")))
        said = "nothing"
    except sinks.SchemaChangeNeedsMigration:
        said = "id string can't become int"
    return spark.createDataFrame([(said, t.version)], "refused string, versions int")


@query("SELECT 'who: missing members age' AS fault UNION ALL SELECT 'all: missing members code, label'")
def g_struct_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Declared members that nested columns lack, in lists too."""
    df = table(spark, sf, "nation").select(F.struct(col("n_name").alias("name")).alias("who"), F.array(F.struct(col("n_nationkey").alias("id"))).alias("all"), F.struct("n_name").alias("same"))
    declared = [Field("who", "struct<name:string,age:int>"), Field("all", "array<struct<id:int,label:string,code:string>>"), Field("same", "struct<n_name:string>")]
    return spark.createDataFrame([(f,) for f in struct_drift(df, declared)], "fault string")


# -- writing --------------------------------------------------------------------
@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def m_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """The second load replaces the first."""
    p, t = Processor(PLAIN | {"name": "o"}, spark), sinks.SnapshotTable(spark, folder(spark))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for df in (o, o.filter("o_orderstatus <> 'P'")):
        p.materialize(p.run(df).good, t)
    return t.read()


def _reprocess(policy: str, partitions: list[str] | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        contract = PLAIN | {"name": "o", "primary_key": ["s_suppkey"], "materialization": {"strategy": "append", "reprocess_policy": policy}}
        p, t = Processor(contract, spark), sinks.SnapshotTable(spark, folder(spark), partitions)
        s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.lit("first").alias("came"))
        p.materialize(s, t)
        p.reprocess(s.filter("s_nationkey < 3 AND s_suppkey % 2 = 0").withColumn("came", F.lit("again")), t)
        return t.read().select("s_suppkey", "s_nationkey", "came")

    again = "SELECT s_suppkey, s_nationkey, 'again' AS came FROM supplier WHERE s_nationkey < 3 AND s_suppkey % 2 = 0"
    first = "SELECT s_suppkey, s_nationkey, 'first' AS came FROM supplier"
    hit = "s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 3 AND s_suppkey % 2 = 0)"
    kept = {"overwrite_partition": f" WHERE NOT ({hit})", "overwrite_all": " WHERE false", "append": "", "merge": " WHERE NOT (s_nationkey < 3 AND s_suppkey % 2 = 0)"}[policy]
    query(f"{first}{kept} UNION ALL {again}", f"m_reprocess_{policy}")(run)


_reprocess("overwrite_partition", ["s_nationkey"])
_reprocess("overwrite_all", None)
_reprocess("append", None)
_reprocess("merge", None)


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey IN (1, 2) THEN 'new' ELSE 'old' END AS state FROM supplier")
def m_merge_touched(spark: SparkSession, sf: str) -> DataFrame:
    """A merge into a partitioned table writes the touched partitions only; all rows are there."""
    contract = PLAIN | {"name": "s", "primary_key": ["s_nationkey", "s_suppkey"], "materialization": {"strategy": "merge"}}
    p, t = Processor(contract, spark), sinks.SnapshotTable(spark, folder(spark), ["s_nationkey"])
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.lit("old").alias("state"))
    p.materialize(s, t)
    p.materialize(s.filter("s_nationkey IN (1, 2)").withColumn("state", F.lit("new")), t)
    return t.read().select("s_suppkey", "s_nationkey", "state")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def m_compact(spark: SparkSession, sf: str) -> DataFrame:
    t = sinks.SnapshotTable(spark, folder(spark))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for s in ("F", "O", "P"):
        t.append(o.filter(col("o_orderstatus") == s))
    t.compact(1)
    return t.read()


@query("SELECT true AS apart, count(*) AS rows FROM lineitem")
def m_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a clustered table hold ranges that don't overlap."""
    path = folder(spark)
    sinks.clustered(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), ["l_partkey"], 4).write.parquet(path)
    each = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"), F.count("*").alias("n"))
    ranked = each.agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"), F.sum("n").alias("rows"))  # one entry a file
    return ranked.select(F.forall(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.col("r")[i]["lo"] > F.col("r")[i - 1]["hi"]).alias("apart"), "rows")


@query("SELECT n_nationkey, n_name, 'json' AS target FROM nation UNION ALL SELECT n_nationkey, n_name, 'parquet' FROM nation")
def m_secondary_targets(spark: SparkSession, sf: str) -> DataFrame:
    path, n = folder(spark), table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.secondary(n, [{"format": f, "path": f"{path}/{f}"} for f in ("json", "parquet")])
    back = [spark.read.schema(n.schema).format(f).load(f"{path}/{f}").withColumn("target", F.lit(f)) for f in ("json", "parquet")]
    return back[0].unionByName(back[1])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def m_ddl(spark: SparkSession, sf: str) -> DataFrame:
    """A table made by generated DDL takes the rows."""
    name = "millrace_" + folder(spark).rsplit("-", 1)[-1]
    spark.sql(create_table(name, [Field("n_nationkey", "int"), Field("n_name", "string"), Field("n_regionkey", "int")]))
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.insertInto(name)
    out = spark.createDataFrame(spark.table(name).collect(), spark.table(name).schema)  # 25 rows, as the table is dropped again
    spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT 2 AS there, 0 AS left_over")
def m_reset(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    for k in ("data", "bad"):
        table(spark, sf, "region").write.parquet(f"{path}/{k}")
    gone = sinks.reset(spark, [f"{path}/{k}" for k in ("data", "bad", "log")])
    return spark.createDataFrame([(len(gone), len(files.existing_paths(spark, [f"{path}/data", f"{path}/bad"])[0]))], "there int, left_over int")


@query("SELECT n_regionkey, count(*) AS rows, 1 AS batch_keys FROM nation GROUP BY 1")
def m_batch_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one file share a batch key; each file has its own."""
    path = folder(spark)
    table(spark, sf, "nation").select("n_regionkey", "n_nationkey").repartition(1).write.partitionBy("n_regionkey").parquet(path)
    out = sinks.batch_fingerprint(spark.read.parquet(path))
    return out.groupBy("n_regionkey").agg(F.count("*").alias("rows"), F.count_distinct("_dc_batch_key").cast("int").alias("batch_keys"))


@query("SELECT 'success' AS place, count(*) AS rows FROM nation")
def m_archive_landing(spark: SparkSession, sf: str) -> DataFrame:
    """Files that were read are moved, and hold all rows."""
    path = folder(spark)
    table(spark, sf, "nation").coalesce(1).write.json(f"{path}/in")
    names = [f"{path}/in/{n}" for n in sinks.Files(spark).names(f"{path}/in") if n.startswith("part-")]
    moved = sinks.archive_landing(spark, names, f"{path}/archive", "nation", ok=True)
    return spark.read.json(moved).agg(F.lit(moved[0].split("/")[-2]).alias("place"), F.count("*").alias("rows"))


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey < 5 AND s_suppkey % 2 = 1 THEN true ELSE false END AS gone FROM supplier")
def m_reconcile_scope(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot of some nations deletes nothing of the others."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    out = M.reconcile(s, s.filter("s_nationkey < 5 AND s_suppkey % 2 = 0"), ["s_suppkey"], M.SoftDelete(), F.expr("s_nationkey < 5"))
    return out.select("s_suppkey", "s_nationkey", F.coalesce(col(M.DELETED), F.lit(False)).alias("gone"))


@query("SELECT s_suppkey, false AS gone FROM supplier")
def m_reconcile_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that were deleted softly are restored when they come back."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    once = M.reconcile(s, s.filter("s_suppkey % 2 = 0"), ["s_suppkey"], M.SoftDelete())
    again = M.reconcile(once, s, ["s_suppkey"], M.SoftDelete())
    return again.select("s_suppkey", F.coalesce(col(M.DELETED), F.lit(False)).alias("gone"))


@query("SELECT 'TooManyDeletes' AS raised, count(*) AS kept FROM supplier")
def m_reconcile_guard(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey")
    try:
        M.reconcile(s, s.filter("s_suppkey % 10 = 0"), ["s_suppkey"], max_delete_ratio=0.5)
        said = "nothing"
    except M.TooManyDeletes as e:
        said = type(e).__name__
    return s.agg(F.lit(said).alias("raised"), F.count("*").alias("kept"))


@query("SELECT c_custkey, 'a' AS _dc_created_at, 'b' AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'a', 'a' FROM customer WHERE c_custkey % 2 = 1")
def l_created_at(spark: SparkSession, sf: str) -> DataFrame:
    """The first creation time survives a merge."""
    c = table(spark, sf, "customer").select("c_custkey", F.lit("a").alias("_dc_created_at"), F.lit("a").alias("state"))
    new = c.filter("c_custkey % 2 = 0").withColumns({"_dc_created_at": F.lit("b"), "state": F.lit("b")})
    return M.upsert(c, new, ["c_custkey"], ("_dc_created_at",))


@query("SELECT 'merge' AS strategy, true AS soft_delete, 'pipeline_log' AS watermark")
def m_cdc_defaults(spark: SparkSession, sf: str) -> DataFrame:
    c = load({"name": "c", "source": {"load_mode": "cdc"}})
    return spark.createDataFrame([(c.strategy, c.materialization["soft_delete"], c.source["watermark_strategy"])], "strategy string, soft_delete boolean, watermark string")


@query("SELECT c_custkey, '_sk,c_custkey,c_mktsegment,effective_from,effective_to,is_current,_version,_change_reason' AS columns FROM customer")
def m_scd2_column_order(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit("2024-01-01").cast("timestamp").alias("at"))
    out = V.apply(None, c, V.Scd2(("c_custkey",), "at", ("c_mktsegment",)))
    return out.select("c_custkey", F.lit(",".join(n for n in out.columns if n != "at")).alias("columns"))


# -- rules ----------------------------------------------------------------------
@query("SELECT count(DISTINCT CASE WHEN event_id % 10 <> 0 THEN user_id END) AS good, count(*) FILTER (event_id % 10 = 0) AS bad FROM events")
def rule_blank_dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without the key of a deduplication are rejected."""
    e = table(spark, sf, "events").select("event_id", F.when(col("event_id") % 10 != 0, col("user_id")).alias("user_id"))
    contract = PLAIN | {"name": "e", "transformations": [{"deduplicate": {"on": ["user_id"], "sort_by": ["event_id"], "order": "desc"}}]}
    n = Processor(contract, spark).run(e).counts()
    return spark.createDataFrame([(n["good"], n["quarantined"])], "good bigint, bad bigint")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 20000")
def rule_phase_placement(spark: SparkSession, sf: str) -> DataFrame:
    """A rule over a column that a post transform makes is judged after it."""
    contract = PLAIN | {"name": "l", "transformations": [{"derive": {"field": "net", "sql": "l_extendedprice * (1 - l_discount)", "phase": "post"}}], "quality": {"row_rules": [{"name": "big", "sql": "net > 20000"}]}}
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return Processor(contract, spark).run(df).good.select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size > 10")
def rule_severity(spark: SparkSession, sf: str) -> DataFrame:
    """A rule rejects whatever its severity."""
    contract = PLAIN | {"name": "p", "quality": {"row_rules": [{"name": "r", "sql": "p_size > 10", "severity": "warning"}]}}
    return Processor(contract, spark).run(table(spark, sf, "part").select("p_partkey", "p_size")).good.select("p_partkey")


@query("SELECT 'QuarantineNotAllowed' AS raised")
def rule_fail_fast(spark: SparkSession, sf: str) -> DataFrame:
    contract = PLAIN | {"name": "p", "quality": {"row_rules": [{"name": "r", "sql": "p_size > 10"}]}, "quarantine": {"fail_on_quarantine": True}}
    try:
        Processor(contract, spark).run(table(spark, sf, "part"))
        said = "nothing"
    except Exception as e:  # noqa: BLE001 - its name is the result
        said = type(e).__name__
    return spark.createDataFrame([(said,)], "raised string")


@query("SELECT 'small' AS rule, count(*) AS rows_evaluated, count(*) FILTER (NOT (l_quantity < 25)) AS failed_rows, CASE WHEN count(*) FILTER (NOT (l_quantity < 25)) = 0 THEN 'passed' ELSE 'failed' END AS status, 'r9' AS run_id FROM lineitem")
def rule_results_record(spark: SparkSession, sf: str) -> DataFrame:
    found = R.check_in_place(table(spark, sf, "lineitem"), [R.custom("small", "l_quantity < 25")])
    out = fleet.rule_results(found, "r9", datetime(2024, 1, 1))
    return out.select("rule", "rows_evaluated", "failed_rows", F.when(col("failed_rows") == 0, "passed").otherwise("failed").alias("status"), "run_id")


@query("SELECT 'o_orderstatus_unique' AS name, count(*) - count(DISTINCT o_orderstatus) = 0 AS passed FROM orders")
def ds_primary_key(spark: SparkSession, sf: str) -> DataFrame:
    """A primary key is judged as unique without a rule that says so."""
    r = Processor(PLAIN | {"name": "o", "primary_key": ["o_orderstatus"]}, spark).run(table(spark, sf, "orders").select("o_orderstatus"))
    return spark.createDataFrame([(x.name, x.passed) for x in r.dataset_results], "name string, passed boolean")


@query("SELECT 'nobody' AS name, true AS passed UNION ALL SELECT 'nulls', false UNION ALL SELECT 'later', NULL")
def ds_null_results(spark: SparkSession, sf: str) -> DataFrame:
    """A null result passes only where no row was looked at; a rule over columns of the write waits."""
    rules = [
        D.statement("nobody", "SELECT max(o_totalprice) FROM source WHERE o_orderkey < 0", greater_than=0),
        D.statement("nulls", "SELECT max(CASE WHEN false THEN o_totalprice END) FROM source", greater_than=0),
        D.statement("later", "SELECT count(*) FROM source WHERE is_current", greater_than=0),
    ]
    found = D.check(table(spark, sf, "orders"), rules, deferred=("later",))
    return spark.createDataFrame([(x.name, x.passed) for x in found], "name string, passed boolean")


@query("SELECT 'quarantine' AS policy, 0::BIGINT AS good, count(*) AS bad FROM orders UNION ALL SELECT 'continue', count(*), 0 FROM orders UNION ALL SELECT 'stop', -1, -1")
def ds_failure_policies(spark: SparkSession, sf: str) -> DataFrame:
    out = []
    for policy in ("quarantine", "continue", "stop"):
        contract = PLAIN | {"name": "o", "quality": {"dataset_rules": [{"row_count_between": {"max": 1}}]}, "quarantine": {"on_dataset_failure": policy}}
        try:
            n = Processor(contract, spark).run(table(spark, sf, "orders").select("o_orderkey")).counts()
            out.append((policy, n["good"], n["quarantined"]))
        except RuntimeError:
            out.append((policy, -1, -1))
    return spark.createDataFrame(out, "policy string, good bigint, bad bigint")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN (SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING NOT (avg(l_discount) < 0.05))")
def ds_scope_where(spark: SparkSession, sf: str) -> DataFrame:
    """Groups are judged by the rows that the rule looks at, and leave whole."""
    rule = D.statement("discount", "SELECT avg(l_discount) FROM source WHERE l_linestatus = 'F'", less_than=0.05, scope=("l_returnflag",))
    return D.split_by_scope(table(spark, sf, "lineitem"), rule)[0].select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS source, count(*) FILTER (p_brand <> 'Brand#11' AND p_size > 10) AS good, count(*) FILTER (p_brand <> 'Brand#11' AND p_size <= 10) AS quarantined, count(*) FILTER (p_brand = 'Brand#11') AS dropped FROM part")
def l_counts(spark: SparkSession, sf: str) -> DataFrame:
    """source = good + quarantined + dropped before the rules."""
    contract = PLAIN | {"name": "p", "transformations": [{"filter": "p_brand <> 'Brand#11'"}], "quality": {"row_rules": [{"name": "r", "sql": "p_size > 10"}]}}
    n = Processor(contract, spark).run(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")).counts()
    return spark.createDataFrame([(n["source"], n["good"], n["quarantined"], n["pre_transform_dropped"])], "source bigint, good bigint, quarantined bigint, dropped bigint")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id DESC)) WHERE rn = 1")
def t_dedup_by_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    one = apply(e, [{"deduplicate": {"on": ["user_id", "ts"], "sort_by": ["event_id"], "order": "desc"}}], Context())
    return apply(one, [{"deduplicate_by_latest": {"on": ["user_id"], "timestamp_column": "ts"}}], Context()).select("user_id", "event_id")


# -- governance, levels, runs ------------------------------------------------------
@query("SELECT n_nationkey, 'gold' AS tier, 7 AS batch FROM nation")
def t_constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    contract = {"name": "n", "lineage": {"enabled": False, "add_columns": {"tier": "gold", "batch": 7}}}
    return Processor(contract, spark).run(table(spark, sf, "nation").select("n_nationkey")).good


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '***REDACTED***' END AS c_name FROM customer")
def v_apply_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Readers of an allowed group see the value, others its mask."""
    contract = PLAIN | {"name": "c", "model": {"fields": [{"name": "c_custkey", "type": "bigint"}, {"name": "c_name", "type": "string", "pii": True, "masking": "redact"}]}, "masking": {"security_groups": ["stewards"]}}
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    p = Processor(contract, spark)
    return p.run(c.filter("c_custkey % 2 = 0"), user_groups={"stewards"}).good.unionByName(p.run(c.filter("c_custkey % 2 = 1"), user_groups={"guests"}).good)


@query("SELECT * FROM (VALUES ('none', 0, 0), ('warn', 0, 5), ('fail', 0, 6), ('pass', 9, 1), ('fail', 8, 2)) AS v(gate, good, bad)")
def o_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(O.quality_gate(0, 0, 0.9), 0, 0), (O.quality_gate(0, 5), 0, 5), (O.quality_gate(0, 6, 0.9), 0, 6), (O.quality_gate(9, 1, 0.9, 0.1), 9, 1), (O.quality_gate(8, 2, 0.9), 8, 2)]
    return spark.createDataFrame(rows, "gate string, good int, bad int")


@query("SELECT max(o_orderdate) >= TIMESTAMP '1998-01-01' AS freshness, count(*) BETWEEN 10 AND 1000000000 AS row_count, count(o_orderstatus) = count(*) AS availability FROM orders")
def o_service_levels(spark: SparkSession, sf: str) -> DataFrame:
    """What a contract promises, judged after its run."""
    levels = {"freshness": {"field": "o_orderdate", "threshold": "30d"}, "row_count": {"min_rows": 10}, "availability": {"field": "o_orderstatus", "threshold": 100}}
    p, t = Processor(PLAIN | {"name": "o", "service_levels": levels}, spark), sinks.SnapshotTable(spark, folder(spark))
    good = p.run(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")).good
    p.materialize(good, t)
    kept = p.service_levels(t, {"good": t.read().count()}, now=datetime(1998, 1, 31))
    return spark.createDataFrame([(kept["freshness"], kept["row_count"], kept["availability"])], "freshness boolean, row_count boolean, availability boolean")


@query("SELECT 5 AS runs, 30 AS days, 'median' AS method")
def o_merge_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = O.merge_slo({"row_count": {"method": "median", "runs": 3}, "days": 30}, {"row_count": {"runs": 5}})
    return spark.createDataFrame([(out["row_count"]["runs"], out["days"], out["row_count"]["method"])], "runs int, days int, method string")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Runs from events: errors failed; reprocessed and empty runs are marked."""
    stage = F.when(col("event_id") % 5 == 0, "reprocess").when(col("event_id") % 7 == 0, "no_new_data").otherwise("run")
    return table(spark, sf, "events").select(
        F.lit("d").alias("dataset"), F.when(col("event_type") == "error", "failed").otherwise("success").alias("status"), stage.alias("stage"), col("ts").cast("timestamp").alias("max_source_mtime"), col("ts").cast("timestamp").alias("timestamp")
    )


@query("SELECT max(ts) AS boundary FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def i_pipeline_log(spark: SparkSession, sf: str) -> DataFrame:
    """The newest file time of successful runs; failed, empty and reprocessed ones don't count."""
    b = incremental.pipeline_log(_log(spark, sf), "d")
    return spark.createDataFrame([(b.start,)], "boundary timestamp").select(col("boundary").cast("timestamp_ntz").alias("boundary"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'")
def i_lookback(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.from_lookback("o_orderdate", "2 months", datetime(1998, 8, 1)).apply(table(spark, sf, "orders")).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (1, 2, 3)")
def i_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions that are written down as done are not read again."""
    path = folder(spark)
    table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").write.partitionBy("s_nationkey").parquet(f"{path}/t")
    done = incremental.Manifest(spark, f"{path}/done")
    done.add([f"s_nationkey={k}" for k in (1, 2)])
    done.add(["s_nationkey=3"])
    left = done.pending(sorted(n for n in sinks.Files(spark).folders(f"{path}/t") if "=" in n))
    return spark.read.parquet(*[f"{path}/t/{n}" for n in left]).select("s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-02-01'")
def i_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments come before what the contract says."""
    said = {"watermark_strategy": "date_range", "watermark_field": "o_orderdate", "from": datetime(1990, 1, 1), "to": datetime(1997, 2, 1)}
    b = incremental.resolve(said, datetime(1998, 1, 1), **{"from": datetime(1997, 1, 1)})
    return b.apply(table(spark, sf, "orders")).select("o_orderkey")


@query("SELECT 'pipeline_log on a table' AS guard, true AS refused UNION ALL SELECT 'delta_version on files', true")
def i_guards(spark: SparkSession, sf: str) -> DataFrame:
    out = []
    for name, said in (("pipeline_log on a table", {"watermark_strategy": "pipeline_log", "type": "table", "dataset": "d"}), ("delta_version on files", {"watermark_strategy": "delta_version", "type": "landing"})):
        try:
            incremental.resolve(said, datetime(2024, 1, 1), runs=spark.createDataFrame([], sinks.RUN_LOG))
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "guard string, refused boolean")


@query("SELECT * FROM (VALUES (1, 'silver'), (2, 'gold'), (3, 'mart')) AS v(place, dataset)")
def l_restatement(spark: SparkSession, sf: str) -> DataFrame:
    """What a changed dataset makes stale, nearest first."""
    found = downstream({"bronze": [], "silver": ["bronze"], "gold": ["silver"], "other": [], "mart": ["gold", "other"]}, ["bronze"])
    return spark.createDataFrame([(i, n) for i, n in enumerate([n for n in found if n != "bronze"], 1)], "place int, dataset string")


@query("SELECT 2.0::DOUBLE AS cost, true AS within")
def l_cost(spark: SparkSession, sf: str) -> DataFrame:
    c = fleet.cost(1800, 4, 1.0, 3.0)
    return spark.createDataFrame([(float(next(v for k, v in c.items() if "cost" in k)), not any(v for k, v in c.items() if "over" in k))], "cost double, within boolean")


@query("SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30') > 0 AS fresh FROM events WHERE event_type <> 'error'")
def o_upstream_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """A run may start where its upstream succeeded within the window."""
    ok, _ = upstream_fresh(_log(spark, sf), "d", datetime(2024, 1, 31), 24.0)
    return spark.createDataFrame([(ok,)], "fresh boolean")


@query("SELECT 'p_partkey' AS \"column\", count(*) AS rows, count(p_partkey) AS non_null, min(p_partkey)::VARCHAR AS min, max(p_partkey)::VARCHAR AS max FROM part UNION ALL SELECT 'p_size', count(*), count(p_size), min(p_size)::VARCHAR, max(p_size)::VARCHAR FROM part")
def g_footer_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Without reading a row."""
    return P.footer_profile(spark, f"{sf}/part.parquet").filter(col("column").isin("p_partkey", "p_size"))


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier")
def t_external_logic(spark: SparkSession, sf: str) -> DataFrame:
    """A function of the user's own comes before everything else."""
    contract = PLAIN | {"name": "s", "external_logic": {"args": {"factor": 2}}}
    p = Processor(contract, spark, external=lambda df, contract, engine, factor: df.withColumn("doubled", col("s_acctbal") * factor))
    return p.run(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")).good.select("s_suppkey", "doubled")


@query("SELECT n_nationkey, upper(n_name) AS loud FROM nation")
def t_engine_override(spark: SparkSession, sf: str) -> DataFrame:
    """An expression for this engine comes before the common one."""
    return apply(table(spark, sf, "nation"), [{"derive": {"field": "loud", "sql": "no_such_function(n_name)", "sql_spark": "upper(n_name)"}}], Context()).select("n_nationkey", "loud")


@query("SELECT event_id, map_keys(m) AS keys FROM (SELECT event_id, MAP {'type': event_type, 'user': user_id::VARCHAR} AS m FROM events)")
def x_map(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("type"), col("event_type"), F.lit("user"), col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.map_keys(m).alias("keys"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props)")
def t_flatten_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter(F.try_parse_json("props").isNotNull()).select("event_id", "props")
    out = flatten_json(e, "props", "struct<k:string>")
    return out.select("event_id", next(col(c) for c in out.columns if c.endswith("k")).alias("k"))


# -- streams --------------------------------------------------------------------
@query("SELECT count(*) AS source, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad, 0::BIGINT AS superseded FROM events")
def s_stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of a stream is good, bad or superseded."""
    base, events = folder(spark), table(spark, sf, "events").select("event_id", "event_type")
    sinks.write_files(events, f"{base}/in")
    contract = PLAIN | {"name": "e", "materialization": {"strategy": "append"}, "quality": {"row_rules": [{"name": "r", "sql": "event_type <> 'error'"}]}}
    t = sinks.SnapshotTable(spark, f"{base}/t")
    n = StreamSink(Processor(contract, spark), file_stream(spark, f"{base}/in", "parquet", events.schema), t, f"{base}/cp", f"{base}/bad").run()
    return spark.createDataFrame([(n.source, t.read().count(), n.bad, n.superseded)], "source bigint, good bigint, bad bigint, superseded bigint")


@query("SELECT 4 AS batches, 200::BIGINT AS rows, 0::BIGINT AS broken")
def s_simulate(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of made-up rides with keys that hold."""
    df = simulate(spark, 4, 50)
    broken = F.count_if(col("ride_id").isNull() | (col("driver_id") < 0) | (col("fare") < 3))
    return df.agg(F.count_distinct("batch").cast("int").alias("batches"), F.count("*").alias("rows"), broken.alias("broken"))




@query("SELECT 5000::BIGINT AS rows, 0::BIGINT AS valid_but_broken, 0::BIGINT AS marked_but_whole, true AS share_is_near")
def g_synthetic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up rows: unmarked ones keep every rule, marked ones break one, about a fifth is marked."""
    fields = [Field("id", "bigint", True), Field("s", "string", accepted_values=("a", "b")), Field("v", "double", min=0, max=10)]
    df = synthesize(spark, fields, 5000, ["id"], 0.2)
    broken = col("id").isNull() | ~F.coalesce(col("s").isin("a", "b"), F.lit(True)) | ~F.coalesce(col("v").between(0, 10), F.lit(True))
    marked = col("_dc_test_case").isNotNull()
    return df.agg(
        F.count("*").alias("rows"), F.count_if(~marked & broken).alias("valid_but_broken"), F.count_if(marked & ~broken).alias("marked_but_whole"), (F.abs(F.count_if(marked) / F.count("*") - 0.2) < 0.05).alias("share_is_near")
    )


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey, 'inserted ' || count(*) OVER () || ' changed ' || count(*) FILTER (s_suppkey % 5 = 0) OVER () || ' again 0' AS written FROM supplier")
def m_database_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows into a database by key: new ones, changed ones, and none a second time (the Derby that Spark brings, in memory)."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:{folder(spark).rsplit('-', 1)[-1]};create=true"
    s = table(spark, sf, "supplier").select("s_suppkey", col("s_nationkey").cast("int").alias("s_nationkey"))
    sinks.execute_jdbc(spark, url, ['CREATE TABLE t ("s_suppkey" BIGINT NOT NULL PRIMARY KEY, "s_nationkey" INT)'])
    new = s.withColumn("s_nationkey", F.when(col("s_suppkey") % 5 == 0, col("s_nationkey") + 100).otherwise(col("s_nationkey")))
    counts = [sinks.upsert_jdbc(df, url, "t", ["s_suppkey"]) for df in (s, new, new)]
    said = f"inserted {counts[0]} changed {counts[1]} again {counts[2]}"
    return read(spark, SourceConfig(format="jdbc", options={"url": url, "dbtable": "t"})).withColumn("written", F.lit(said))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for every tenth customer, one twice; some are closed, some are for another system."""
    c = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(col("c_custkey").cast("string").alias("subject_id"), "c_custkey")
    c = c.unionByName(c.filter("c_custkey % 20 = 0"))
    status = F.when(col("c_custkey") % 30 == 0, "completed").when(col("c_custkey") % 40 == 0, "dry_run").otherwise("pending")
    named = {"request_id": F.concat(F.lit("r"), "subject_id"), "framework": F.lit("gdpr"), "subject_column": F.lit("c_custkey"), "status": status, "system": F.when(col("c_custkey") % 70 == 0, "crm")}
    rows = c.withColumns(named)
    kinds = dict(p.rsplit(" ", 1) for p in E.REQUESTS.split(", "))
    return rows.select(*[(col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


_WAITING = "c_custkey % 10 = 0 AND c_custkey % 30 <> 0 AND c_custkey % 70 <> 0"


def _worked_off(spark: SparkSession, sf: str) -> tuple[DataFrame, sinks.SnapshotTable, sinks.SnapshotTable]:
    path = folder(spark)
    requests, evidence = sinks.SnapshotTable(spark, f"{path}/requests"), sinks.SnapshotTable(spark, f"{path}/evidence")
    requests.write(_requests(spark, sf))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = E.work_off(c, requests, evidence, "c_custkey", [G.Masked("c_name", "redact")], "r1", "customer", datetime(2024, 5, 1), system="erp")
    return out, requests, evidence


@query(f"SELECT c_custkey, CASE WHEN {_WAITING} THEN '***REDACTED***' ELSE c_name END AS c_name, {_WAITING} AS gone FROM customer")
def v_erasure_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting requests of this system are worked off; closed ones and those of another system aren't."""
    return _worked_off(spark, sf)[0].select("c_custkey", "c_name", col("_dc_is_deleted").alias("gone"))


@query(f"""WITH s AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 20 = 0)
SELECT CASE WHEN {_WAITING} OR c_custkey % 30 = 0 THEN 'completed' WHEN c_custkey % 40 = 0 THEN 'dry_run' ELSE 'pending' END AS status, count(*) AS requests, (SELECT count(*) FROM customer WHERE {_WAITING}) AS evidence_subjects FROM s GROUP BY 1""")
def v_erasure_evidence(spark: SparkSession, sf: str) -> DataFrame:
    _, requests, evidence = _worked_off(spark, sf)
    n = evidence.read().select(F.sum("subject_count").alias("n")).first()["n"]
    return requests.read().groupBy("status").agg(F.count("*").alias("requests")).withColumn("evidence_subjects", F.lit(n).cast("long"))


@query("SELECT c_custkey, sha2 AS c_name FROM (SELECT c_custkey, sha256('s' || c_name) AS sha2 FROM customer)")
def v_mask_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of a frame that goes to developers."""
    return G.apply_masks(table(spark, sf, "customer").select("c_custkey", "c_name"), [G.Masked("c_name", "hash")], salt="s")


@query("SELECT n_nationkey, TIMESTAMP '2024-05-01 10:00:00' AS at, DATE '2024-05-01' AS day, 'now() and current_date' AS word FROM nation")
def t_one_instant(spark: SparkSession, sf: str) -> DataFrame:
    """All SQL of a run has one instant, in every phase; texts keep their words."""
    made = [{"derive": {"field": f, "sql": s, "phase": p}} for f, s, p in (("at", "NOW()", "pre"), ("late", "CURRENT_TIMESTAMP", "post"), ("day", "current_date", "post"), ("word", "'now() and current_date'", "post"))]
    rule = {"name": "same", "sql": "at = late AND at <= current_timestamp()"}
    p = Processor(PLAIN | {"name": "n", "transformations": made, "quality": {"row_rules": [rule]}}, spark)
    out = p.run(table(spark, sf, "nation").select("n_nationkey"), at=datetime(2024, 5, 1, 10)).good
    return out.select("n_nationkey", col("at").cast("timestamp_ntz").alias("at"), "day", "word")
