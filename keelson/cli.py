"""Command line: check, inspect, plan, run, verify, config import, import-load.

Source tables are those of the configured server, read over JDBC, or with --catalog staged files <staging>/<table> (Parquet, or CSV with
--format csv) with a catalogue as JSON; the target is the configured server, or with --target a folder of Parquet tables. Exit codes: 0 done, 1 failure or unclear outcome, 2 refused before
anything ran, 3 rows rejected, 4 verification, 130 cancelled.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from keelson.plans.model import to_json


def _import_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("load")
    p.add_argument("output")
    p.add_argument("--consistency", choices=("frozen", "single_snapshot"), required=True)
    p.add_argument("--target-schema")
    p.add_argument("--source-env", default="SOURCE_URL")
    p.add_argument("--target-env", default="TARGET_URL")
    p.add_argument("--append-data-only", action="store_true")
    p.add_argument("--accept-defaults", action="store_true")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keelson")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "inspect", "plan", "run"):
        c = sub.add_parser(name)
        c.add_argument("config")
        if name != "check":
            c.add_argument("--catalog", help="a catalogue as JSON instead of the server's")
        if name in ("plan", "run"):
            c.add_argument("--target-catalog")
            c.add_argument("--target", help="a folder of Parquet tables instead of the configured server")
            c.add_argument("--shared", help="a folder that every executor reaches, for rows on their way to a server")
        if name == "run":
            c.add_argument("--staging", help="staged files instead of the server's tables")
            c.add_argument("--format", default="parquet")
    v = sub.add_parser("verify")
    v.add_argument("run_dir")
    v.add_argument("--staging", required=True)
    v.add_argument("--target", required=True)
    v.add_argument("--format", default="parquet")
    v.add_argument("--config", help="refuse runs with other endpoints than this configuration's")
    _import_arguments(sub.add_parser("import-load"))
    _import_arguments(sub.add_parser("config").add_subparsers(dest="action", required=True).add_parser("import"))
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("keelson").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _reader(spark, staging: str, kind: str):
    from keelson.sources.catalog import staged

    return lambda t: staged(spark, f"{staging}/{t.source_name}" + (".csv" if kind == "csv" else ""), kind)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from keelson.plans.planner import Blocked, build, select
    from keelson.sources import artifacts, catalog, config, load_import

    try:
        if a.command in ("import-load", "config"):
            made = load_import.import_load(Path(a.load).read_text("utf-8"), load_import.Options(a.source_env, a.target_env, a.consistency, a.target_schema, a.append_data_only, a.accept_defaults))
            with open(a.output, "x", encoding="utf-8") as f:  # never overwrites
                f.write(made.toml)
            return 0
        if a.command == "verify":
            return _verify(a)
        c = config.load(a.config)
        if a.command == "check":
            print("the configuration is valid")
            return 0
        from keelson.sources import jdbc

        spark = None
        if a.catalog:
            source = catalog.load_source(Path(a.catalog).read_text("utf-8"))
        else:
            spark, url = _session(), artifacts.resolve_url(c.source.url_env, c.source.url_file)
            source = jdbc.inspect(jdbc.reader(spark, jdbc.read_options(url, c)))
        if a.command == "inspect":
            chosen, others = select(c, source)
            print(json.dumps({"database": source.database, "selected": [t.name for t in chosen], "excluded": others}, indent=1))
            return 0
        from keelson.plans.run import Run, summary

        if a.target_catalog:
            target = catalog.load_target(Path(a.target_catalog).read_text("utf-8"))
        else:
            spark = spark or _session()
            schemas = sorted({c.target.schema, *(r.schema for r in c.tables.rename if r.schema)})
            target = _target(spark, a, c).catalog(schemas)
        plan = build(c, source, target)
        if a.command == "plan":
            print(artifacts.safe(to_json(plan)))
            return 0
        spark = spark or _session()
        show = (lambda e: print(json.dumps(e), flush=True)) if c.report.console == "json" else (lambda e: None)
        said: list = []
        rows = _reader(spark, a.staging, a.format) if a.staging else jdbc.source_tables(spark, artifacts.resolve_url(c.source.url_env, c.source.url_file), c, source, said.append)
        run = Run(spark, c, plan, rows, _target(spark, a, c), show)
        report = run.go()
        report.diagnostics += said
        print(to_json(report) if c.report.console == "json" else summary(report))
        return report.exit_code()
    except (config.ConfigError, load_import.ImportRefused, Blocked, OSError, ValueError) as e:
        for d in getattr(e, "diagnostics", []):
            print(artifacts.safe(f"{d.severity}: {d.code} {d.object}: {d.message}"), file=sys.stderr)
        print(artifacts.safe(str(e)), file=sys.stderr)
        return 2


def _target(spark, a: argparse.Namespace, c):
    from keelson.plans.run import FileTarget

    if a.target:
        return FileTarget(spark, a.target)
    from keelson.operators.closure import shared_folder
    from keelson.sources import artifacts, jdbc, server

    options = jdbc.connection_options(artifacts.resolve_url(c.target.url_env, c.target.url_file), c)
    known = {k: v for k, v in options.items() if k not in ("batchsize", "isolationLevel")}
    return server.ServerTarget(spark, options, a.shared or shared_folder(spark), jdbc.reader(spark, known), server.executor(spark, options))


def _verify(a: argparse.Namespace) -> int:
    from keelson.operators.verify import verify
    from keelson.plans.run import FileTarget
    from keelson.sources import artifacts

    digests = ()
    if a.config:
        from keelson.sources import config

        c = config.load(a.config)
        digests = (artifacts.known_digest(c.source), artifacts.known_digest(c.target))
    plan, report = artifacts.saved_run(a.run_dir, *digests)
    spark = _session()
    target = FileTarget(spark, a.target)
    states = {t.id: target.states(t.target_schema, t.target_name) for t in plan.tables}
    report.verification = verify(plan, report, _reader(spark, a.staging, a.format), target.read, held=target.held, states=states)
    print(to_json(report.verification))
    return report.exit_code()


if __name__ == "__main__":
    sys.exit(main())
