"""Command line: ``python -m millrace validate|lint|ddl|run|profile|infer|export-odcs|import-dbt``."""

from __future__ import annotations

import argparse
import json
import sys

import yaml


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    from .plans import authoring as A
    from .plans.contract import load

    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "lint", "export-odcs", "import-dbt"):
        sub.add_parser(name).add_argument("file")
    ddl = sub.add_parser("ddl")
    ddl.add_argument("file")
    ddl.add_argument("--table", required=True)
    ddl.add_argument("--dialect", default="spark")
    run = sub.add_parser("run")
    run.add_argument("file")
    run.add_argument("--target", required=True)
    run.add_argument("--quarantine")
    run.add_argument("--log")
    run.add_argument("--stage")
    for name in ("profile", "infer"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--format", default="parquet")
    args = parser.parse_args(argv)
    text = open(args.file).read() if hasattr(args, "file") else ""
    if args.command in ("validate", "lint"):
        found = A.lint(text)
        for f in found:
            print(f"{f.severity}: {f.code} {f.message}")
        return int(any(f.severity == "critical" for f in found))
    if args.command == "ddl":
        c = load(text)
        print(A.create_table(args.table, c.fields, args.dialect, c.materialization.get("partition_by") or [], c.primary_key))
    elif args.command == "export-odcs":
        print(yaml.safe_dump(A.to_odcs(load(text)), sort_keys=False))
    elif args.command == "import-dbt":
        for model in yaml.safe_load(text).get("models", []):
            print(yaml.safe_dump(A.from_dbt(model), sort_keys=False))
    elif args.command == "run":
        from .plans.processor import Processor
        from .sources.sinks import RunLog, SnapshotTable

        spark = _session()
        counts = Processor(text, spark, stage=args.stage).run_all(SnapshotTable(spark, args.target), args.quarantine, RunLog(spark, args.log) if args.log else None)
        print(json.dumps(counts))
    else:
        from .operators.profile import profile
        from .sources.files import SourceConfig, read

        df = read(_session(), SourceConfig(args.path, args.format))
        if args.command == "profile":
            for r in profile(df).collect():  # one row per column
                print(json.dumps(r.asDict()))
        else:
            print(yaml.safe_dump(A.infer(df, args.path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]), sort_keys=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
