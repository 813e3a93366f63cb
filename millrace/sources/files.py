"""Reading landing files into frames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import any_of, col
from ..functions.types import is_numeric, spark_type
from ..operators.rules import READ_ERROR
from ..operators.schema import Field, flatten
from .sinks import only_driver_reaches, read_here


@dataclass
class SourceConfig:
    """Where rows come from and how they are written down."""

    path: str | list[str] = ""
    format: str = "parquet"
    table: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    fields: list[Field] = field(default_factory=list)
    #: text conventions: decimal_comma, date_formats {field: pattern}, booleans {true: [...], false: [...]}, trim
    text: dict[str, Any] = field(default_factory=dict)
    flatten_nested: bool = False
    #: keys in folder names (key=value) that become columns
    partition_keys: list[str] = field(default_factory=list)


def missing_integration(name: str):
    raise NotImplementedError(f"{name} needs an integration that is not installed; register one with sources.register()")


READERS: dict[str, Any] = {}


def register(name: str):
    """Add a reader (session, config) -> frame for a format."""

    def add(f):
        READERS[name] = f
        return f

    return add


def read(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """A frame from a source of any registered format."""
    if config.table:
        df = spark.table(config.table)
    elif config.format in READERS:
        df = READERS[config.format](spark, config)
    else:
        missing_integration(f"format {config.format!r}")
    if config.text:
        df = text_conventions(df, config.fields, config.text)
    return flatten(df) if config.flatten_nested else df


#: what a source's type says of its format
TYPES = {"table": "table", "delta": "delta", "iceberg": "iceberg", "database": "jdbc", "sftp": "sftp", "dlt": "dlt", "mongodb": "mongodb", "rest": "rest", "api": "rest"}


def source_config(source: dict[str, Any], fields: list[Field] = ()) -> SourceConfig:
    """A contract's source, by its type: landing and stream are files of their format, others name what they are."""
    kind = source.get("type")
    if kind is not None and kind not in {*TYPES, "landing", "stream", "files", "file"}:
        raise ValueError(f"unknown source type: {kind!r}")
    options = dict(source.get("options") or {})
    format = TYPES.get(kind) or source.get("format", "parquet")
    if kind == "database":
        options |= {"url": source.get("url") or options.get("url"), "dbtable": source.get("table") or options.get("dbtable")}
    by_name = source.get("table") if kind != "database" else None
    if kind == "table" and not by_name:
        by_name = source.get("path")
    return SourceConfig(source.get("path", source.get("url", "")), format, by_name, options, list(fields), source.get("text") or {}, bool(source.get("flatten_nested")))


def _paths(config: SourceConfig) -> list[str]:
    return [config.path] if isinstance(config.path, str) else list(config.path)


@register("parquet")
def _parquet(spark: SparkSession, c: SourceConfig) -> DataFrame:
    reader = spark.read.option("mergeSchema", c.options.get("merge_schema", False))
    if c.options.get("base_path"):
        reader = reader.option("basePath", c.options["base_path"])
    return reader.parquet(*_paths(c))


@register("orc")
def _orc(spark: SparkSession, c: SourceConfig) -> DataFrame:
    return spark.read.orc(_paths(c))


@register("csv")
def _csv(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """All columns as text; further null values and skipped head rows are dealt with after the read.

    With skipped head rows a record is a line.
    """
    o = c.options
    reader = spark.read.option("sep", o.get("delimiter", ",")).option("encoding", o.get("encoding", "UTF-8")).option("quote", o.get("quote_char", '"'))
    reader = reader.option("escape", o.get("escape", '"')).option("multiLine", o.get("multiline", False)).option("inferSchema", False)
    if o.get("comment_prefix"):
        reader = reader.option("comment", o["comment_prefix"])
    skip, nulls = int(o.get("skip_rows", 0)), list(o.get("null_values") or [])
    if not skip:
        reader = reader.option("header", o.get("has_header", True))
        if not o.get("has_header", True) and c.fields:
            reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in c.fields]))
        df = reader.csv(_paths(c))
    else:  # the head of each file is cut by line number, then lines are parsed
        # lines are numbered within their block of a file, so that no file meets in one task; only first blocks have a head
        lines = spark.read.text(_paths(c)).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__at"))
        names = [f.name for f in c.fields] or _header(lines, skip, o)
        drop = skip + (1 if o.get("has_header", True) else 0)

        def body(batches):
            import pyarrow as pa

            last, seen = None, 0
            for batch in batches:
                file, start, keep = batch.column(1), batch.column(2), []
                for k in range(batch.num_rows):
                    here = (file[k].as_py(), start[k].as_py())
                    last, seen = (here, 0) if here != last else (last, seen + 1)
                    keep.append(here[1] > 0 or seen >= drop)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["value"])

        schema = ", ".join(f"`{n}` string" for n in names)
        parsed = lines.mapInArrow(body, "value string").select(F.from_csv("value", schema, {"sep": o.get("delimiter", ","), "quote": o.get("quote_char", '"'), "escape": o.get("escape", '"')}).alias("r"))
        df = parsed.select("r.*")
    if nulls:
        df = df.withColumns({n: F.when(~col(n).isin(nulls), col(n)) for n in df.columns})
    return df


@register("tsv")
def _tsv(spark: SparkSession, c: SourceConfig) -> DataFrame:
    c.options.setdefault("delimiter", "\t")
    return _csv(spark, c)


def _header(lines: DataFrame, skip: int, options: dict) -> list[str]:
    import csv

    head = lines.filter("__at = 0").select("value").take(skip + 1)
    return next(csv.reader([head[skip]["value"]], delimiter=options.get("delimiter", ","), quotechar=options.get("quote_char", '"')))


@register("json")
def _json(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """JSON lines or one array per file; which, is seen from the first character."""
    multi = c.options.get("multiline")
    if multi is None:
        first = spark.read.text(_paths(c), wholetext=False).filter(F.length(F.trim("value")) > 0).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
        multi = bool(first) and first["c"] == "["
    reader = spark.read.option("multiLine", multi).option("columnNameOfCorruptRecord", READ_ERROR)
    if c.fields:
        kinds = [T.StructField(f.name, T.StringType() if not (f.type or "").startswith(("struct", "array<", "map<")) else spark_type(f.type)) for f in c.fields]
        reader = reader.schema(T.StructType([*kinds, T.StructField(READ_ERROR, T.StringType())]))
        df = reader.json(_paths(c))
        return df.withColumn(READ_ERROR, F.when(col(READ_ERROR).isNotNull(), F.concat(F.lit("Unreadable record: "), F.substring(col(READ_ERROR), 1, 80))))
    return reader.option("primitivesAsString", c.options.get("all_text", False)).json(_paths(c))


READERS["ndjson"] = READERS["jsonl"] = READERS["json"]


@register("xml")
def _xml(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """One row per record element; nested parts as JSON text."""
    df = spark.read.format("xml").option("rowTag", c.options["row_tag"]).option("ignoreNamespace", True).option("inferSchema", c.options.get("infer", False)).load(",".join(_paths(c)))
    return df if c.flatten_nested else df.select(*[(F.to_json(col(f.name)) if isinstance(f.dataType, T.StructType | T.ArrayType) else col(f.name)).alias(f.name) for f in df.schema])


@register("fixed_width")
def _fixed(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """Fields by (start, length) or by widths; head and tail lines by their prefix; short records are errors."""
    o = c.options
    lines = spark.read.option("lineSep", o.get("line_sep", "\n")).text(_paths(c))
    for prefix in [*o.get("skip_prefixes", [])]:
        lines = lines.filter(~F.col("value").startswith(prefix))
    spans, at = [], 1
    for name, width in o["layout"]:
        start, n = width if isinstance(width, list | tuple) else (at, width)
        spans.append((name, start, n))
        at = start + n
    need = o.get("record_length") or max(s + n - 1 for _, s, n in spans)
    bad = F.when(F.length("value") < need, F.concat(F.lit(f"Record shorter than {need}: "), F.length("value").cast("string")))
    return lines.select(*[F.trim(F.substring("value", s, n)).alias(name) for name, s, n in spans], bad.alias(READ_ERROR))


@register("text")
def _text(spark: SparkSession, c: SourceConfig) -> DataFrame:
    return spark.read.text(_paths(c), wholetext=c.options.get("whole", False))


@register("binary")
def _binary(spark: SparkSession, c: SourceConfig) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if c.options.get("pattern"):
        reader = reader.option("pathGlobFilter", c.options["pattern"])
    return reader.load(_paths(c))


@register("zip")
def _zip(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """Lines of the members of zip archives that match a pattern; an archive is unpacked where it is read."""
    pattern, encoding = c.options.get("member_pattern", ".*"), c.options.get("encoding", "utf-8")

    def unpack(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if re.search(pattern, member):
                            with z.open(member) as f:
                                held: list[str] = []
                                for line in io.TextIOWrapper(f, encoding):
                                    held.append(line.rstrip("\r\n"))
                                    if len(held) == 10_000:
                                        yield pd.DataFrame({"archive": path, "member": member, "value": held})
                                        held = []
                                if held:
                                    yield pd.DataFrame({"archive": path, "member": member, "value": held})

    lines = spark.read.format("binaryFile").load(_paths(c)).select("path", "content").mapInPandas(unpack, "archive string, member string, value string")
    if c.options.get("inner") == "csv":
        names = [f.name for f in c.fields]
        head = c.options.get("delimiter", ",").join(names)
        parsed = lines.filter(F.col("value") != head).select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": c.options.get("delimiter", ",")}).alias("r"))
        return parsed.select("r.*")
    return lines


@register("jdbc")
def _jdbc(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """A database table or query; with bounds it is read in parallel ranges."""
    o = c.options
    how = {"url": o["url"], "fetchsize": str(o.get("fetch_size", 10_000))} | ({"query": o["query"]} if o.get("query") else {"dbtable": o["dbtable"]})
    how |= {k: o[k] for k in ("user", "password", "driver") if o.get(k)}
    reader = spark.read.format("jdbc").options(**how)
    if o.get("partition_column"):
        reader = reader.option("partitionColumn", o["partition_column"]).option("lowerBound", o["lower"]).option("upperBound", o["upper"]).option("numPartitions", o.get("partitions", 8))
    df = reader.load()
    if only_driver_reaches(spark, o["url"]):
        df = read_here(df, how)
    names = [f.name for f in c.fields if f.name in df.columns]
    return df.select(*names) if names else df


for _name in ("delta", "iceberg", "avro"):

    def _package(spark: SparkSession, c: SourceConfig, name: str = _name) -> DataFrame:
        reader = spark.read.format(name)
        for k, o in (("version", "versionAsOf"), ("timestamp", "timestampAsOf"), ("starting_version", "startingVersion"), ("ending_version", "endingVersion")):
            if c.options.get(k) is not None:
                reader = reader.option(o, c.options[k])
        if c.options.get("change_feed"):
            reader = reader.option("readChangeFeed", True)
        return reader.load(*_paths(c))

    READERS[_name] = _package

for _name in ("mongodb", "sftp", "dlt", "kinesis", "pubsub"):
    READERS[_name] = lambda spark, c, name=_name: missing_integration(name)


@register("excel")
def _excel(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """Rows of a sheet of xlsx workbooks as text; ``sheet`` (name or number), ``header_row`` (None without one), ``skip_footer``."""
    o = c.options
    how = {"sheet": o.get("sheet", 0), "header_row": o.get("header_row", 0), "skip_footer": int(o.get("skip_footer", 0))}
    books = spark.read.format("binaryFile").load(_paths(c)).select("content")
    names = [f.name for f in c.fields]
    declared = bool(names)
    if how["header_row"] is not None and not names:

        def head(frames):
            import pandas as pd

            from .excel import table

            for frame in frames:
                yield pd.DataFrame({"names": [next(table(bytes(b), **how)) for b in frame["content"]]})

        first = books.limit(1).mapInPandas(head, "names array<string>").first()
        names = [n or f"column_{i}" for i, n in enumerate(first["names"])] if first else names

    def rows(frames):
        import pandas as pd

        from .excel import table

        for frame in frames:
            for content in frame["content"]:
                lines, held, order = table(bytes(content), **how), [], None
                if how["header_row"] is not None and not o.get("by_place"):  # by name: a workbook may have its columns in another order
                    own = [n or f"column_{i}" for i, n in enumerate(next(lines))]
                    if set(own) - set(names) and not declared:
                        raise ValueError(f"workbooks have different columns ({sorted(set(own) - set(names))}); declare the fields that are wanted")
                    order = [own.index(n) if n in own else None for n in names]
                elif how["header_row"] is not None:
                    next(lines)
                for line in lines:
                    held.append([line[k] if k is not None and k < len(line) else None for k in (order or range(len(names)))])
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return books.mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))


@register("rest")
def _rest(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """Pages of a web API; ``options`` are those of a RestSource, and ``landing``, the folder that rows are written to."""
    from . import rest

    options = dict(c.options)
    landing = options.pop("landing")
    options.pop("fetch", None)
    schema = ", ".join(f"`{f.name}` {(spark_type(f.type) or T.StringType()).simpleString()}" for f in c.fields)
    return rest.read_rest(spark, rest.RestSource(str(c.path), **options), landing, schema, c.options.get("fetch", rest.fetch_json))


def records(spark: SparkSession, rows: list[dict], fields: list[Field]) -> DataFrame:
    """A frame from rows in memory, by the declared types."""
    schema = T.StructType([T.StructField(f.name, spark_type(f.type) or T.StringType()) for f in fields])
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], schema)


# -- text conventions -------------------------------------------------------
def decimal_comma(value: Column) -> Column:
    """``1.234,50`` as ``1234.50``."""
    return F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def text_conventions(df: DataFrame, fields: list[Field], text: dict[str, Any]) -> DataFrame:
    """Trimming, decimal commas, date patterns and words for true and false, on text columns."""
    out: dict[str, Column] = {}
    kinds = {f.name: spark_type(f.type) for f in fields}
    for f in df.schema:
        if not isinstance(f.dataType, T.StringType):
            continue
        c, kind = col(f.name), kinds.get(f.name)
        if text.get("trim"):
            c = F.trim(c)
        if text.get("decimal_comma") and kind is not None and is_numeric(kind):
            c = decimal_comma(c)
        pattern = (text.get("date_formats") or {}).get(f.name)
        if pattern:
            c = F.coalesce(F.try_to_timestamp(c, F.lit(pattern)).cast("string"), c) if isinstance(kind, T.TimestampType) else F.coalesce(F.try_to_date(c, pattern).cast("string"), c)
        words = text.get("booleans")
        if words and isinstance(kind, T.BooleanType):
            low = F.lower(c)
            c = F.when(low.isin([str(w).lower() for w in words.get("true", [])]), "true").when(low.isin([str(w).lower() for w in words.get("false", [])]), "false").otherwise(c)
        out[f.name] = c
    return df.withColumns(out) if out else df


# -- landing folders --------------------------------------------------------
def partition_paths(base: str, pattern: str, start: datetime | date, end: datetime | date, granularity: str = "day") -> list[str]:
    """Folders of a strftime pattern from start to end, both included."""
    step = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}[granularity]
    out, at = [], start
    while at <= end:
        path = f"{base.rstrip('/')}/{at.strftime(pattern)}"
        if not out or out[-1] != path:
            out.append(path)
        at += step
    return out


def existing_paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """(present, missing) of some paths; globs count as present where anything matches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    present, missing = [], []
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        found = h.getFileSystem(conf).globStatus(h)
        (present if found is not None and len(found) else missing).append(p)
    return present, missing


def read_partitions(spark: SparkSession, config: SourceConfig, paths: list[str]) -> DataFrame | None:
    """The folders that exist, or None."""
    present, _ = existing_paths(spark, paths)
    if not present:
        return None
    return read(spark, SourceConfig(present, config.format, None, config.options, config.fields, config.text, config.flatten_nested))


def with_path_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``key=value`` parts of the file's path as columns, only those declared."""
    return df.withColumns({k: F.nullif(F.regexp_extract(F.input_file_name(), rf"(?:^|/){re.escape(k)}=([^/]*)", 1), F.lit("")) for k in keys})


def modified_since(spark: SparkSession, config: SourceConfig, since: datetime) -> DataFrame:
    """Rows of files that changed after a moment; other files are not opened."""
    c = SourceConfig(config.path, config.format, config.table, config.options, config.fields, config.text, config.flatten_nested)
    return read(spark, c).filter(F.col("_metadata.file_modification_time") > F.lit(since))


def reprocess(df: DataFrame, column: str, low: str | None = None, high: str | None = None, values: list | None = None) -> DataFrame:
    """Rows of an inclusive range (a bare end date means its whole day), or with listed values."""
    if values is not None:
        return df.filter(col(column).isin(values))
    tests = []
    if low is not None:
        tests.append(col(column) < F.lit(low).cast(df.schema[column].dataType))
    if high is not None:
        end = f"{high}T23:59:59.999999" if re.fullmatch(r"\d{4}-\d\d-\d\d", high) and not isinstance(df.schema[column].dataType, T.DateType) else high
        tests.append(col(column) > F.lit(end).cast(df.schema[column].dataType))
    return df.filter(~any_of(tests)) if tests else df


def normalise_cdc(df: DataFrame, op: str = "__$operation", to: str = "_dc_cdc_op") -> DataFrame:
    """Change-table codes as words: 1 delete, 2 insert, 4 update; before-images (3) go."""
    word = F.when(col(op) == 1, "delete").when(col(op) == 2, "insert").when(col(op) == 4, "update")
    return df.filter(col(op) != 3).withColumn(to, word).drop(op)
