import json

from pyspark.sql import functions as F

from millrace.plans.processor import Processor
from millrace.sources.sinks import SnapshotTable
from millrace.streaming.sink import StreamSink, decode, file_stream, keyset_pages, simulate, windowed
from millrace.operators.rules import READ_ERROR
from millrace.operators.schema import Field

RIDES = {
    "name": "rides", "primary_key": ["ride_id"], "lineage": {"enabled": False}, "materialization": {"strategy": "merge"},
    "model": {"fields": [{"name": "ride_id", "type": "bigint"}, {"name": "fare", "type": "double", "min": 0}, {"name": "status", "type": "string"}]},
}


def test_decode_reports_poison(spark):
    df = spark.createDataFrame([('{"ride_id": 1, "fare": 2.5}', 0, 1), ("oops", 0, 2), ("[1]", 0, 3), (None, 0, 4)], "value string, partition int, offset long")
    out = {r.offset: r for r in decode(df, [Field("ride_id"), Field("fare")]).collect()}
    assert (out[1].ride_id, out[1].fare, out[1][READ_ERROR]) == ("1", "2.5", None)
    assert "invalid JSON (partition 0 offset 2): oops" in out[2][READ_ERROR] and "not an object" in out[3][READ_ERROR] and out[4][READ_ERROR]


def test_stream_to_table_with_updates_and_poison(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"ride_id": 1, "fare": 5, "status": "started"}), json.dumps({"ride_id": 1, "fare": 9, "status": "completed"}), "not json", json.dumps({"ride_id": 2, "fare": "x", "status": "a"})]
    (src / "a.txt").write_text("\n".join(lines))
    stream = file_stream(spark, str(src), "text", "value string").withColumn("offset", F.length("value").cast("long"))
    table = SnapshotTable(spark, str(tmp_path / "t"))
    seen = []
    sink = StreamSink(Processor(RIDES, spark), stream, table, str(tmp_path / "cp"), str(tmp_path / "bad"), ["ride_id"], ["status"], json_value="value", on_batch=lambda i, n: seen.append(n))
    sink.order = ["fare"]
    counts = sink.run()
    assert [(r.ride_id, r.fare, r.status) for r in table.read().select("ride_id", "fare", "status").collect()] == [(1, 9.0, "completed")]
    assert (counts.good, counts.bad, counts.superseded, counts.source) == (1, 2, 1, 4) and len(seen) == 1
    again = StreamSink(Processor(RIDES, spark), stream, table, str(tmp_path / "cp"), None, json_value="value").run()
    assert again.batches == 0  # nothing new behind the checkpoint


def test_windows_over_a_stream(spark, tmp_path):
    simulate(spark, 2, 30).write.parquet(str(tmp_path / "s"))
    stream = file_stream(spark, str(tmp_path / "s"), "parquet", spark.read.parquet(str(tmp_path / "s")).schema)
    q = windowed(stream, "event_time", "10 seconds", {"n": "count(*)"}, late="1 minute").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 60


def test_keyset_pages(spark):
    df = spark.range(25)
    pages = list(keyset_pages(lambda c: df.filter(F.col("id") > (c if c is not None else -1)).orderBy("id").limit(10), "id"))
    assert [c for _, c in pages] == [9, 19, 24]
