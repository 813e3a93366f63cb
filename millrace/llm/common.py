"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of an Arrow batch, at most: texts are long, and a batch is in memory more than once
ARROW_ROWS = 1000
CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made for it, but only with a local
    master (unit tests on one machine): executors elsewhere couldn't read it.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of Arrow batches of this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`cut`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator call in the shared folder.

    ``cut`` writes a frame as Parquet there and reads it again, so that later
    steps neither recompute it nor depend on the executors that made it.
    ``drop`` removes a table as soon as no later step reads it; what the
    returned frame still needs is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._clean)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        # zstd, as snappy's direct buffers stay until a full collection and add up over many small tables
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are tables by now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path = getattr(f, "_millrace_path", None)
            if path:
                delete_path(self.spark, path)

    def _clean(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def unused_prefix(df: DataFrame) -> str:
    """A prefix that no column name of ``df`` begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def uniform(*cols) -> F.Column:
    """A number in [0, 1) that depends on ``cols`` only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
