"""Writing frames: snapshot tables on Parquet, plain files, quarantine and run log.

A :class:`SnapshotTable` writes data into new folders only and then one small file that lists the
folders of its new version.  Readers take the highest version whose file is whole.  So a merge can
read the table that it writes, a write that fails at any point changes nothing, of two writers of
one version one fails, and old states can be read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, try_cast
from ..functions.types import can_widen, is_nested
from ..operators.rules import CATEGORIES, ERRORS


class Files:
    """Small files and folders through Hadoop's file systems, wherever they are."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A new file; False if there is one already."""
        p, fs = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:  # noqa: BLE001 - raised by the file system, of any kind
            if fs.exists(p):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def move(self, source: str, target: str) -> None:
        p, fs = self._at(source)
        t = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(t.getParent())
        fs.rename(p, t)


class SchemaChangeNeedsMigration(RuntimeError):
    """A write would need stored data to be rewritten."""


def align(existing: DataFrame, incoming: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both frames with united columns: new ones are added, removed ones kept, types widened in place; other changes are refused."""
    if strict and set(existing.columns) != set(incoming.columns):
        raise SchemaChangeNeedsMigration(f"columns differ: {sorted(set(existing.columns) ^ set(incoming.columns))}")
    for f in incoming.schema:
        if f.name not in existing.columns:
            existing = existing.withColumn(f.name, F.lit(None).cast(f.dataType))
            continue
        old = existing.schema[f.name].dataType
        if old == f.dataType:
            continue
        if can_widen(old, f.dataType):
            existing = existing.withColumn(f.name, col(f.name).cast(f.dataType))
        elif can_widen(f.dataType, old):
            incoming = incoming.withColumn(f.name, col(f.name).cast(old))
        else:
            raise SchemaChangeNeedsMigration(f"{f.name}: {old.simpleString()} can't become {f.dataType.simpleString()}")
    for f in existing.schema:
        if f.name not in incoming.columns:
            incoming = incoming.withColumn(f.name, F.lit(None).cast(f.dataType))
    return existing, incoming.select(*[col(c) for c in existing.columns])


class ConcurrentWrite(RuntimeError):
    """Another writer has stored the version that this one was about to."""


@dataclass(frozen=True)
class Part:
    """Files of one write: a folder, of a partitioned table one of its partition folders."""

    root: str
    folder: str
    schema: str
    #: values of the batch key, if there are few
    batches: tuple[str | None, ...] | None = None


class SnapshotTable:
    """A table as a list of folders, one list a version."""

    LOG, END = "_versions", "end"
    #: values of a batch key that are written down
    BATCHES = 1000

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None, keep: int = 2):
        self.spark, self.path, self.partition_by, self.keep = spark, path.rstrip("/"), partition_by or [], keep
        self.files = Files(spark)
        for other in ("_delta_log", "metadata"):
            if self.files.exists(f"{self.path}/{other}"):
                raise RuntimeError(f"{self.path} holds a table of another format")

    # -- versions ----------------------------------------------------------------
    def _log(self, v: int) -> str:
        return f"{self.path}/{self.LOG}/{v:012d}"

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.path}/{self.LOG}") if n.isdigit())

    def parts(self, version: int) -> list[Part] | None:
        """What a version consists of; None if its file is missing or was cut off."""
        lines = (self.files.read(self._log(version)) or "").split("\n")
        if lines[-1] != self.END:
            return None
        return [Part(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(x).items()}) for x in lines[:-1]]

    @property
    def version(self) -> int:
        """The newest whole version; 0 without any."""
        return next((v for v in reversed(self._numbers()) if self.parts(v) is not None), 0)

    def _commit(self, parts: list[Part], after: int) -> int:
        v = max([after, *self._numbers()]) + 1
        if self.version != after:
            raise ConcurrentWrite(f"{self.path}: version {self.version} is there, but {after} was read")
        if not self.files.create(self._log(v), "\n".join([*(json.dumps(vars(p)) for p in parts), self.END])):
            raise ConcurrentWrite(f"{self.path}: version {v} is there already")
        self._clean(v)
        return v

    def _clean(self, v: int) -> None:
        """Versions and folders that no kept version needs go."""
        numbers = self._numbers()
        whole = [n for n in numbers if n <= v and self.parts(n) is not None]
        kept = whole[-self.keep :]
        needed = {p.root for n in kept for p in self.parts(n) or []}
        dropped = {p.root for n in whole[: -self.keep] for p in self.parts(n) or []} - needed
        for root in dropped:
            self.files.delete(f"{self.path}/{root}")
        for n in numbers:
            if n < kept[0]:
                self.files.delete(self._log(n))

    # -- reading -----------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame | None:
        parts = self.parts(version or self.version)
        return None if parts is None else self._frame(parts)

    def _frame(self, parts: list[Part]) -> DataFrame | None:
        """The rows of some parts, later columns and wider types over all of them."""
        by: dict[tuple[str, str], list[Part]] = {}
        for p in parts:
            by.setdefault((p.schema, p.root if p.folder else ""), []).append(p)
        out: DataFrame | None = None
        for (schema, root), group in by.items():
            reader = self.spark.read.schema(T.StructType.fromJson(json.loads(schema)))
            if root:
                reader = reader.option("basePath", f"{self.path}/{root}")
            df = reader.parquet(*[f"{self.path}/{p.root}/{p.folder}".rstrip("/") for p in group])
            df = df.select(*[col(f["name"]) for f in json.loads(schema)["fields"]])
            out = df if out is None else (lambda x: x[0].unionByName(x[1]))(align(out, df))
        return out

    # -- writing -----------------------------------------------------------------
    def _store(self, df: DataFrame, batch_key: str | None = None) -> list[Part]:
        """The frame in a new folder that no version knows yet."""
        root = f"data/{uuid.uuid4().hex}"
        keys = [p for p in self.partition_by if p in df.columns]
        writer = df.write.mode("error")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{self.path}/{root}")
        batches = None
        if batch_key:
            found = df.select(col(batch_key).cast("string")).distinct().limit(self.BATCHES + 1).collect()
            batches = tuple(r[0] for r in found) if len(found) <= self.BATCHES else None
        folders = [""]
        for _ in keys:
            folders = [f"{f}/{n}".lstrip("/") for f in folders for n in self.files.folders(f"{self.path}/{root}/{f}".rstrip("/")) if "=" in n]
        return [Part(root, f, df.schema.json(), batches) for f in folders]

    def write(self, df: DataFrame) -> int:
        """The frame as the new state."""
        after = self.version
        return self._commit(self._store(df), after)

    def change(self, step: Callable[[DataFrame | None], DataFrame]) -> int:
        after = self.version
        return self._commit(self._store(step(self.read(after) if after else None)), after)

    def append(self, df: DataFrame, batch_key: str | None = None) -> int:
        """Rows added as new files; an earlier copy of the same batch (by its key column, null as a value) is replaced.

        Of what is stored only folders that may hold rows of these batches are read and written again.
        """
        after = self.version
        old = self.parts(after) or []
        if old:
            align(self._frame(old).limit(0), df.limit(0))  # columns that can't be united are refused
        new = self._store(df, batch_key)
        if batch_key and old and new:
            mine = new[0].batches
            stale = [p for p in old if mine is None or p.batches is None or set(mine) & set(p.batches)]
            if stale:
                kept = self._frame(stale)
                if batch_key in kept.columns:
                    batch = df.select(col(batch_key).cast(kept.schema[batch_key].dataType).alias("__batch")).distinct()
                    kept = kept.join(batch, col(batch_key).eqNullSafe(F.col("__batch")), "left_anti")
                    old = [p for p in old if p not in stale]
                    if not kept.isEmpty():
                        new = [*self._store(kept, batch_key), *new]
        return self._commit(old + new, after)

    def merge_partitions(self, incoming: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """``merge(rows of the partitions that the batch touches, batch)``, stored in place of these partitions; all others stay as they are."""
        after = self.version
        if not self.partition_by:
            return self.change(lambda old: merge(old, incoming))
        touched = {tuple(r) for r in incoming.select(*[col(k).cast("string") for k in self.partition_by]).distinct().collect()}  # one a partition
        old = self.parts(after) or []
        hit = [p for p in old if not p.folder or self._values(p) in touched]
        # a part without partition folders may hold any partition, and is merged whole
        state = self._frame(hit) if hit else None
        return self._commit([p for p in old if p not in hit] + self._store(merge(state, incoming)), after)

    @staticmethod
    def _values(part: Part) -> tuple[str | None, ...]:
        raw = [unquote(f.split("=", 1)[1]) for f in part.folder.split("/")]
        return tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in raw)

    def compact(self, files: int) -> int:
        return self.change(lambda old: old.coalesce(files))


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str], format: str = "parquet") -> None:
    """Only the partitions in the batch are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).format(format).save(path)


def write_files(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, options: dict[str, Any] | None = None) -> None:
    """Plain files; CSV gets nested values as JSON text."""
    if format == "csv":
        df = df.select(*[(F.to_json(col(f.name)) if is_nested(f.dataType) else col(f.name)).alias(f.name) for f in df.schema])
        options = {"header": True} | (options or {})
    writer = df.write.mode(mode).format(format).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*[p for p in partition_by if p in df.columns])
    writer.save(path)


def batch_fingerprint(df: DataFrame, to: str = "_dc_batch_key") -> DataFrame:
    """Path, size and time of each row's file as one key, or a hash of the row where it comes from no file."""
    names = df.columns
    try:
        m = F.col("_metadata")
        return df.withColumn(to, F.sha2(F.concat_ws("|", m.file_path, m.file_size.cast("string"), m.file_modification_time.cast("string")), 256)).select(*[col(c) for c in names], to)
    except Exception:  # noqa: BLE001 - no file behind the frame
        return df.withColumn(to, F.sha2(F.to_json(F.struct(*[col(c) for c in names])), 256))


def quarantine(bad: DataFrame, run_columns: dict[str, Column] | None = None) -> DataFrame:
    """Rejected rows as they are stored: error text, lineage, and the arrays as text."""
    out = bad.withColumns(run_columns or {})
    if ERRORS in bad.columns:
        out = out.withColumn("_dc_error_text", F.concat_ws("; ", col(ERRORS))).withColumns({ERRORS: F.to_json(col(ERRORS)), CATEGORIES: F.to_json(col(CATEGORIES))})
    return out


def reprocess_quarantine(stored: DataFrame, rerun: Callable[[DataFrame], tuple[DataFrame, DataFrame]], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass now, quarantine with those marked as reprocessed)."""
    active = stored.filter((F.col("quarantine_state") == "active") & ~F.col("quarantine_reprocessed"))
    helper = [c for c in stored.columns if c.startswith("_dc_") or c.startswith("quarantine_")]
    good, _ = rerun(active.drop(*helper))
    hit = good.select(*[try_cast(col(k), stored.schema[k].dataType).alias(k) for k in key]).distinct().withColumn("__ok", F.lit(True))
    marked = stored.join(hit, key, "left").withColumn("quarantine_reprocessed", F.col("quarantine_reprocessed") | F.coalesce("__ok", F.lit(False)))
    state = F.when(F.col("quarantine_reprocessed"), "reprocessed").otherwise(F.col("quarantine_state"))
    return good, marked.withColumn("quarantine_state", state).drop("__ok").select(*stored.columns)


RUN_LOG = (
    "run_id string, dataset string, environment string, stage string, status string, timestamp timestamp, duration_s double, counts_source bigint, counts_good bigint, "
    "counts_quarantined bigint, counts_dropped bigint, quality_gate string, max_source_mtime timestamp, watermark string, message string"
)


class RunLog:
    """Runs as an append-only Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, **row: Any) -> None:
        names = [p.split()[0] for p in RUN_LOG.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_LOG).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        if not Files(self.spark).exists(self.path):
            return self.spark.createDataFrame([], RUN_LOG)
        return self.spark.read.schema(RUN_LOG).parquet(self.path)


def archive_landing(spark: SparkSession, files: list[str], archive: str, table: str, ok: bool, delete: bool = False) -> list[str]:
    """Files that were read, moved to ``<archive>/<table>/success|error`` or deleted."""
    fs, out = Files(spark), []
    for f in files:
        if delete and ok:
            fs.delete(f)
        else:
            target = f"{archive.rstrip('/')}/{table}/{'success' if ok else 'error'}/{f.rsplit('/', 1)[-1]}"
            fs.move(f, target)
            out.append(target)
    return out


#: databases inside the process that opens them, and how their addresses begin where a server holds them
EMBEDDED = {"derby": ("//",), "h2": ("tcp:", "ssl:"), "hsqldb": ("hsql:", "hsqls:", "http:", "https:"), "sqlite": (), "duckdb": ()}


def only_driver_reaches(spark: SparkSession, url: str) -> bool:
    """Whether a database lives inside one process while tasks run in others: each of these would open one of its own."""
    kind, at = url.split(":", 2)[1:]
    return kind in EMBEDDED and not at.startswith(EMBEDDED[kind]) and not spark.sparkContext._jsc.sc().isLocal()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, partitions: int | None = None, **properties: str) -> None:
    """Rows into a database table (its driver must be on the class path)."""
    options = {"url": url, "dbtable": table, "batchsize": str(batch)} | properties
    here = only_driver_reaches(df.sparkSession, url)
    if here and mode == "ignore" and _jdbc_schema(df.sparkSession, options):
        return
    frame = df.coalesce(partitions) if partitions else df
    (df.limit(0) if here else frame).write.format("jdbc").mode(mode).options(**options).save()  # without rows no task runs, but the table is made
    if here:
        _write_here(df, options)


def _jdbc_schema(spark: SparkSession, options: dict[str, Any]):
    """A table's schema as the JVM holds it; None if there is no such table."""
    jvm = spark.sparkContext._jvm
    jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc
    how = jdbc.JdbcOptionsInWrite(jvm.PythonUtils.toScalaMap(options))
    connection = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).createConnectionFactory(how).apply(-1)
    try:
        found = jdbc.JdbcUtils.getSchemaOption(connection, how)
    finally:
        connection.close()
    return found if found.isDefined() else None


#: rows that the driver holds at once, about, while it writes them itself
BROUGHT = 100_000


def _write_here(df: DataFrame, options: dict[str, Any]) -> None:
    """Rows into a table that only the driver reaches: they come one partition of bounded size at a time and are written by its JVM, each in a transaction."""
    spark, df = df.sparkSession, df.repartition(max(1, -(-df.count() // BROUGHT)))
    jvm = spark.sparkContext._jvm
    jdbc, context = jvm.org.apache.spark.sql.execution.datasources.jdbc, getattr(getattr(jvm.org.apache.spark, "TaskContext$"), "MODULE$")
    how, dialect = jdbc.JdbcOptionsInWrite(jvm.PythonUtils.toScalaMap(options)), jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"])
    schema, exact = df._jdf.schema(), spark.conf.get("spark.sql.caseSensitive") == "true"
    insert = jdbc.JdbcUtils.getInsertStatement(options["dbtable"], schema, _jdbc_schema(spark, options), exact, dialect)
    rows, wanted = df._jdf.toDF().toJavaRDD(), spark.sparkContext._gateway.new_array(jvm.int, 1)
    for i in range(rows.getNumPartitions()):
        wanted[0] = i
        part = jvm.scala.jdk.javaapi.CollectionConverters.asScala(rows.collectPartitions(wanted)[0].iterator())
        context.setTaskContext(context.empty())  # Spark's writer counts its rows there
        try:
            jdbc.JdbcUtils.savePartition(options["dbtable"], part, schema, insert, how.batchSize(), dialect, how.isolationLevel(), how)
        finally:
            context.unset()


def read_here(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """The rows of a JDBC frame whose database only the driver reaches, read by its JVM; they must fit the driver, as most such databases do."""
    spark = df.sparkSession
    jvm, schema = spark.sparkContext._jvm, df._jdf.schema()
    how = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap(options))
    connection = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).createConnectionFactory(how).apply(-1)
    try:
        statement = connection.createStatement()
        statement.setFetchSize(how.fetchSize())
        found = statement.executeQuery(f"SELECT * FROM {how.tableOrQuery()}")
        rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(found, schema).toList()
    finally:
        connection.close()
    return DataFrame(spark._jsparkSession.createDataFrame(jvm.scala.jdk.javaapi.CollectionConverters.asJava(rows), schema), spark)


def _merge_sql(url: str, table: str, staging: str, keys: list[str], names: list[str]) -> list[str]:
    """Statements that bring staged rows into a table; rows that wouldn't change are left alone."""
    rest = [n for n in names if n not in keys]
    listed, source = ", ".join(names), ", ".join(f"s.{n}" for n in names)
    kind = url.split(":")[1]
    if kind in ("postgresql", "sqlite", "duckdb"):
        changed = " OR ".join(f"{table}.{n} IS DISTINCT FROM excluded.{n}" if kind != "sqlite" else f"{table}.{n} IS NOT excluded.{n}" for n in rest)
        action = f"DO UPDATE SET {', '.join(f'{n} = excluded.{n}' for n in rest)} WHERE {changed}" if rest else "DO NOTHING"
        return [f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} WHERE true ON CONFLICT ({', '.join(keys)}) {action}"]
    if kind in ("mysql", "mariadb"):
        action = ", ".join(f"{n} = VALUES({n})" for n in rest) or f"{keys[0]} = {keys[0]}"
        return [f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON DUPLICATE KEY UPDATE {action}"]
    same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    changed = " OR ".join(f"t.{n} <> s.{n} OR (t.{n} IS NULL AND s.{n} IS NOT NULL) OR (t.{n} IS NOT NULL AND s.{n} IS NULL)" for n in rest)
    update = f" WHEN MATCHED AND ({changed}) THEN UPDATE SET {', '.join(f'{n} = s.{n}' for n in rest)}" if rest else ""
    end = ";" if kind == "sqlserver" else ""
    return [f"MERGE INTO {table} {'AS ' if kind != 'oracle' else ''}t USING {staging} {'AS ' if kind != 'oracle' else ''}s ON {same}{update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({source}){end}"]


def execute_jdbc(spark: SparkSession, url: str, statements: list[str], driver: str | None = None, user: str | None = None, password: str | None = None) -> int:
    """Statements in one transaction, from the driver; rows that they changed."""
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    how = jvm.java.util.Properties()
    for k, v in (("user", user), ("password", password)):
        if v is not None:
            how.setProperty(k, v)
    connection, changed = jvm.java.sql.DriverManager.getConnection(url, how), 0
    try:
        connection.setAutoCommit(False)
        for sql in statements:
            s = connection.createStatement()
            changed += max(0, s.executeUpdate(sql))
            s.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
    return changed


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], batch: int = 10_000, partitions: int | None = None, batch_key: str | None = None, **how: str) -> int:
    """Rows into a database table by their keys: new ones inserted, changed ones updated, others untouched; how many were written.

    Rows go to a staging table of their own in parallel; one statement in one transaction then merges them, so a write
    that fails leaves the table as it was.  Keys must be unique in ``df``.  With ``batch_key`` rows of the
    same batches that are no longer sent go.
    """
    spark, staging = df.sparkSession, f"stg_{uuid.uuid4().hex[:20]}"
    # names as the database has them: Spark creates tables with quoted names
    quote = "`" if url.split(":")[1] in ("mysql", "mariadb") else '"'
    names = [f"{quote}{c}{quote}" for c in df.columns]
    marked = [f"{quote}{k}{quote}" for k in keys]
    access = {k: how.get(k) for k in ("driver", "user", "password")}
    statements = _merge_sql(url, table, staging, marked, names)
    if batch_key:
        b, same = f"{quote}{batch_key}{quote}", " AND ".join(f"{staging}.{k} = {table}.{k}" for k in marked)
        statements.insert(0, f"DELETE FROM {table} WHERE {b} IN (SELECT {b} FROM {staging}) AND NOT EXISTS (SELECT 1 FROM {staging} WHERE {same})")
    # staged in the types of the table
    listed, kind = ", ".join(names), url.split(":")[1]
    make = f"SELECT {listed} INTO {staging} FROM {table} WHERE 1 = 0" if kind == "sqlserver" else f"CREATE TABLE {staging} AS SELECT {listed} FROM {table} " + ("WITH NO DATA" if kind in ("derby", "db2") else "WHERE 1 = 0")
    execute_jdbc(spark, url, [make], **access)
    try:
        write_jdbc(df, url, staging, "append", batch, partitions, **how)
        return execute_jdbc(spark, url, statements, **access)
    finally:
        execute_jdbc(spark, url, [f"DROP TABLE {staging}"], **access)


#: rows and bytes of one range of a clustered table, about
RANGE_ROWS, RANGE_BYTES = 1_000_000, 128 << 20


def clustered(df: DataFrame, cluster_by: list[str], partitions: int | None = None) -> DataFrame:
    """Rows laid out by some columns, so that file statistics let scans skip: ranges, sorted inside.

    There are more ranges than asked for where these would hold too much, so that no task grows with the table;
    rows of one key stay in one range.
    """
    cols = [col(c) for c in cluster_by if c in df.columns]
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if is_nested(f.dataType) else c), F.lit(0)) for f in df.schema if is_nested(f.dataType) or isinstance(f.dataType, T.StringType | T.BinaryType) for c in [col(f.name)]]
    size = sum(wide, F.lit(16 * len(df.columns)).cast("long"))
    held = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    need = max(-(-held["rows"] // RANGE_ROWS), -(-held["size"] // RANGE_BYTES))
    if need > (partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
        partitions = need
    return df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols) if partitions else df.repartitionByRange(*cols).sortWithinPartitions(*cols)


def reset(spark: SparkSession, paths: list[str]) -> list[str]:
    """Delete a contract's data, quarantine and log; the paths that were there."""
    files = Files(spark)
    there = [p for p in paths if files.exists(p)]
    for p in there:
        files.delete(p)
    return there


def describe(spark: SparkSession, table: str, comment: str | None = None, columns: dict[str, str] | None = None, properties: dict[str, str] | None = None) -> None:
    """Comments and properties of a catalog table."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {table} IS {quote(comment)}")
    for name, text in (columns or {}).items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{name}` COMMENT {quote(text)}")
    if properties:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({', '.join(f'{quote(k)} = {quote(v)}' for k, v in properties.items())})")


def secondary(df: DataFrame, targets: list[dict[str, Any]]) -> None:
    """The same rows to further targets; the frame is computed once."""
    df = df.persist()
    try:
        for t in targets:
            if t["format"] == "jdbc" and t.get("mode") == "upsert":
                upsert_jdbc(df, t["url"], t["table"], t["keys"], **t.get("properties", {}))
            elif t["format"] == "jdbc":
                write_jdbc(df, t["url"], t["table"], t.get("mode", "append"), **t.get("properties", {}))
            else:
                write_files(df, t["path"], t["format"], t.get("mode", "overwrite"), t.get("partition_by"))
    finally:
        df.unpersist()
