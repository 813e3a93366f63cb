"""Contracts over streams: every micro-batch is decoded, validated and stored; Spark's checkpoint is the only cursor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import all_of, any_of, as_timestamp, col
from ..operators.rules import READ_ERROR
from ..operators.schema import Field
from ..sources.sinks import SnapshotTable, quarantine


def decode(df: DataFrame, fields: list[Field], value: str = "value", where: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """Message texts as declared fields in text; records that can't be read keep a row that says why and where."""
    text = col(value).cast("string")
    members = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    place = F.concat_ws(" ", *[F.concat(F.lit(f"{c} "), col(c).cast("string")) for c in where if c in df.columns])
    shown = F.substring(F.coalesce(text, F.lit("null")), 1, 80)
    is_object = F.trim(text).startswith("{")
    valid = F.try_parse_json(text).isNotNull()
    fault = F.when(text.isNull() | ~valid, F.concat(F.lit("Unreadable record: invalid JSON ("), place, F.lit("): "), shown)).when(
        ~is_object, F.concat(F.lit("Unreadable record: not an object ("), place, F.lit("): "), shown)
    )
    made = [F.when(valid & is_object, members[f.name]).alias(f.name) for f in fields]
    kept = [col(c) for c in df.columns if c in where or c in ("timestamp", "topic")]
    return df.select(*made, *[c for c in kept], fault.alias(READ_ERROR))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to apply, superseded rows): the last event of each key in a batch; rows without a key, and unreadable ones, all stay."""
    whole = all_of(col(k).isNotNull() for k in keys)
    if READ_ERROR in df.columns:
        whole = whole & col(READ_ERROR).isNull()
    by = [col(c).desc_nulls_last() for c in order] + [F.xxhash64(*[F.to_json(F.struct(col(c))) for c in df.columns])]  # ties go by the whole row
    n = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*by))
    keyed = df.filter(whole).withColumn("__n", n)
    last = keyed.filter("__n = 1").drop("__n").unionByName(df.filter(~whole))
    return last, keyed.filter("__n > 1").drop("__n")


@dataclass
class Counts:
    """What the batches so far came to: source = good + bad + superseded."""

    batches: int = 0
    good: int = 0
    bad: int = 0
    superseded: int = 0
    per_batch: list[dict[str, int]] = field(default_factory=list)

    @property
    def source(self) -> int:
        return self.good + self.bad + self.superseded


class StreamSink:
    """A processor over a stream.  A batch is stored before its offsets are committed, under its batch id, so a replay replaces it."""

    def __init__(
        self, processor, stream: DataFrame, table: SnapshotTable, checkpoint: str, quarantine_path: str | None = None, keys: list[str] | None = None, order: list[str] | None = None,
        json_value: str | None = None, on_batch: Callable[[int, dict[str, int]], None] | None = None,
    ):
        self.processor, self.stream, self.table, self.checkpoint = processor, stream, table, checkpoint
        self.quarantine_path, self.keys, self.order, self.json_value, self.on_batch = quarantine_path, keys or [], order or [], json_value, on_batch
        self.counts = Counts()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once, though it is counted, stored and quarantined
        try:
            self._process(batch, batch_id)
        finally:
            batch.unpersist()

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        df = decode(batch, self.processor.contract.fields, self.json_value) if self.json_value else batch
        superseded = 0
        if self.keys and self.order:
            df, old = latest_per_key(df, self.keys, self.order)
            superseded = old.count()
        result = self.processor.run(df, run_id=f"batch-{batch_id}")
        n = {"good": result.good.count(), "bad": result.bad.count(), "superseded": superseded}
        if n["good"]:
            good = result.good
            if self.processor.contract.strategy == "append":
                self.table.append(good.withColumn("_dc_batch_id", F.lit(batch_id).cast("long")), "_dc_batch_id")
            else:
                self.processor.materialize(good, self.table)
        if n["bad"] and self.quarantine_path:
            quarantine(result.bad).withColumn("_dc_batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.quarantine_path}/batch={batch_id}")
        self.counts.batches += 1
        self.counts.good += n["good"]
        self.counts.bad += n["bad"]
        self.counts.superseded += superseded
        self.counts.per_batch.append(n)
        if self.on_batch:
            self.on_batch(batch_id, n)

    def run(self, mode: str = "available_now", every: str = "30 seconds", timeout: float | None = None) -> Counts:
        writer = self.stream.writeStream.option("checkpointLocation", self.checkpoint).foreachBatch(self.process)
        writer = writer.trigger(availableNow=True) if mode == "available_now" else writer.trigger(processingTime=every)
        query = writer.start()
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
        if query.isActive:
            query.stop()
        return self.counts


def file_stream(spark: SparkSession, path: str, format: str, schema: str | T.StructType, max_files: int | None = None) -> DataFrame:
    """Each new file once."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(format).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, options: dict[str, str] | None = None) -> DataFrame:
    """Messages of a topic (the Kafka package must be on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return reader.options(**(options or {})).load()


def table_stream(spark: SparkSession, path: str, format: str = "delta") -> DataFrame:
    return spark.readStream.format(format).load(path)


# -- event time -------------------------------------------------------------
def windowed(df: DataFrame, time: str, size: str, aggs: dict[str, str], keys: tuple[str, ...] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates of tumbling or sliding windows; with ``late`` a watermark lets state be dropped."""
    if late:
        df = df.withWatermark(time, late)
    w = F.window(col(time), size, slide) if slide else F.window(col(time), size)
    out = df.groupBy(w.alias("w"), *[col(k) for k in keys]).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[col(k) for k in keys], *[col(n) for n in aggs])


def sessions(df: DataFrame, time: str, gap: str, keys: tuple[str, ...], aggs: dict[str, str], late: str | None = None) -> DataFrame:
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.session_window(col(time), gap).alias("w"), *[col(k) for k in keys]).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[col(k) for k in keys], *[col(n) for n in aggs])


def distinct_events(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keyset_pages(read: Callable[[object], DataFrame], field: str, start: object = None):
    """Pages of a source by a growing key: (frame, cursor) until a page is empty."""
    cursor = start
    while True:
        page = read(cursor)
        top = page.agg(F.max(col(field))).first()[0]
        if top is None:
            return
        yield page, top
        cursor = top


def simulate(spark: SparkSession, batches: int, rows: int, cities: tuple[str, ...] = ("London", "Paris", "Berlin"), seed: int = 1, start: str = "2024-01-01") -> DataFrame:
    """Ride events by window: batch, ride_id, driver_id, city, fare, status, event_time; foreign keys hold."""
    base = spark.range(batches * rows)
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6).cast("double")
    pick: Column = F.element_at(F.array(*[F.lit(c) for c in cities]), (F.floor(u(1) * len(cities)) + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("requested", "started", "completed", "cancelled")]), (F.floor(u(2) * 4) + 1).cast("int"))
    return base.select(
        (F.floor(F.col("id") / rows)).cast("long").alias("batch"),
        F.col("id").alias("ride_id"),
        (F.floor(u(3) * 100)).cast("long").alias("driver_id"),
        pick.alias("city"),
        F.round(3 + u(4) * 40, 2).alias("fare"),
        status.alias("status"),
        (F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("event_time"),
    )


def at_fault(df: DataFrame, rules: list[Column]) -> Column:
    return any_of(~F.coalesce(r, F.lit(False)) for r in rules)


def event_age(time: str, now: Column) -> Column:
    return now.cast("timestamp") - as_timestamp(col(time))
