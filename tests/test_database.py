"""Database reads and writes, against the Derby that comes with Spark (which can't take null texts from Spark)."""

import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators.schema import Field
from millrace.sources import sinks
from millrace.sources.files import read, source_config


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def stored(spark, url, table="t"):
    return sorted(tuple(r) for r in spark.read.format("jdbc").option("url", url).option("dbtable", table).load().collect())


def create(spark, url):
    sinks.execute_jdbc(spark, url, ['CREATE TABLE t ("id" INT NOT NULL PRIMARY KEY, "v" INT, "b" VARCHAR(5))'])


def test_upsert_inserts_updates_and_leaves_alone(spark, url):
    create(spark, url)
    kind = "id int, v int, b string"
    rows = spark.createDataFrame([(i, i, "b1") for i in range(50)], kind)
    assert sinks.upsert_jdbc(rows, url, "t", ["id"]) == 50
    assert sinks.upsert_jdbc(rows, url, "t", ["id"]) == 0  # nothing changed, nothing written
    new = spark.createDataFrame([(1, -1, "b1"), (2, None, "b1"), (3, 3, "b1"), (99, 5, "b2")], kind)
    assert sinks.upsert_jdbc(new, url, "t", ["id"]) == 3
    got = {r[0]: r[1] for r in stored(spark, url)}
    assert got[1] == -1 and got[2] is None and got[3] == 3 and got[99] == 5 and len(got) == 51
    assert sinks.upsert_jdbc(spark.createDataFrame([(2, 7, "b1")], kind), url, "t", ["id"]) == 1


def test_a_batch_is_replaced(spark, url):
    create(spark, url)
    kind = "id int, v int, b string"
    sinks.upsert_jdbc(spark.createDataFrame([(1, 1, "b1"), (2, 1, "b1"), (3, 1, "b2")], kind), url, "t", ["id"])
    sinks.upsert_jdbc(spark.createDataFrame([(1, 3, "b1"), (4, 3, "b1")], kind), url, "t", ["id"], batch_key="b")
    assert stored(spark, url) == [(1, 3, "b1"), (3, 1, "b2"), (4, 3, "b1")]


def test_a_failed_upsert_leaves_the_table(spark, url):
    create(spark, url)
    sinks.upsert_jdbc(spark.createDataFrame([(1, 1, "b")], "id int, v int, b string"), url, "t", ["id"])
    with pytest.raises(Exception, match="(?i)truncat|length"):
        sinks.upsert_jdbc(spark.createDataFrame([(1, 3, "b"), (2, 3, "longer than five")], "id int, v int, b string"), url, "t", ["id"])
    assert stored(spark, url) == [(1, 1, "b")]
    tables = spark.read.format("jdbc").option("url", url).option("query", "SELECT tablename FROM sys.systables WHERE tabletype = 'T'").load()
    assert [r[0] for r in tables.collect()] == ["T"]  # no staging table is left


def test_append_and_read_by_source(spark, url):
    sinks.write_jdbc(spark.range(100).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name")), url, "people")
    config = source_config({"type": "database", "url": url, "table": "people", "options": {"partition_column": '"id"', "lower": 0, "upper": 100, "partitions": 4}}, [Field("id", "int")])
    df = read(spark, config)
    assert df.columns == ["id"] and df.rdd.getNumPartitions() == 4 and sorted(r.id for r in df.collect()) == list(range(100))
    sinks.secondary(spark.createDataFrame([(1, "changed")], "id int, name string"), [{"format": "jdbc", "url": url, "table": "people", "mode": "append"}])
    assert len(stored(spark, url, "people")) == 101


def test_statements_by_database():
    names, keys = ["id", "v"], ["id"]
    assert sinks._merge_sql("jdbc:postgresql://h/d", "t", "s", keys, names) == ["INSERT INTO t (id, v) SELECT id, v FROM s WHERE true ON CONFLICT (id) DO UPDATE SET v = excluded.v WHERE t.v IS DISTINCT FROM excluded.v"]
    assert "ON DUPLICATE KEY UPDATE v = VALUES(v)" in sinks._merge_sql("jdbc:mysql://h/d", "t", "s", keys, names)[0]
    assert sinks._merge_sql("jdbc:sqlserver://h", "t", "s", keys, names)[0].endswith("VALUES (s.id, s.v);")
    assert "DO NOTHING" in sinks._merge_sql("jdbc:duckdb:", "t", "s", keys, ["id"])[0]


def test_unknown_source_types_are_refused():
    with pytest.raises(ValueError, match="unknown source type"):
        source_config({"type": "carrier pigeon"})
    assert source_config({"type": "landing", "path": "p", "format": "csv"}).format == "csv"


IN_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1] + "/tests")
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).config("spark.sql.warehouse.dir", sys.argv[2] + "/w").getOrCreate()
import __spark_entry__ as entry
from oracle import FOLDER, same
from millrace.sources import sinks
same(spark, entry.queries()["m_database_upsert"], entry.oracle_sql()["m_database_upsert"])
url, rows = "jdbc:derby:memory:c;create=true", spark.range(10).repartition(3)
stored = lambda: sorted(r[0] for r in sinks.read_here(spark.read.format("jdbc").option("url", url).option("dbtable", "t").load(), {"url": url, "dbtable": "t"}).collect())
for mode, n in (("append", 10), ("append", 20), ("ignore", 20), ("overwrite", 10)):
    sinks.write_jdbc(rows, url, "t", mode)
    assert len(stored()) == n
sinks.BROUGHT = 3
sinks.write_jdbc(spark.range(10, 20), url, "t")
assert stored() == list(range(20)) and not sinks.only_driver_reaches(spark, "jdbc:derby://host/d")
print("equal")
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_a_database_inside_the_driver_of_a_cluster(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": f"{repo}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", IN_A_CLUSTER, repo, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.stdout.split()[-1:] == ["equal"], done.stderr[-3000:]
