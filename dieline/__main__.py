"""python -m dieline COMMAND: the public functions on a command line."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile

from pyspark.sql import SparkSession

from . import api
from .functions import render


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="dieline")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **flags) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place.rstrip("+"), **({"nargs": "+"} if place.endswith("+") else {}))
        for flag, default in flags.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else int}
            p.add_argument(f"--{flag.replace('_', '-')}", **kind)
        return p

    command("info", "path")
    command("dump", "path", limit=None)
    command("check", "path")
    command("batch-check", "inputs+", output="")
    command("to-ascii", "path", "output")
    command("convert", "path", "output", batch_size=10_000, no_overwrite=False)
    command("convert-many", "inputs+", output="", partition_by="lot-id")
    command("convert-partitioned", "inputs+", output="", partition_by="lot-id,wafer-id", max_pending_tests=100_000, row_group_rows=65_536, max_sources=10_000, continue_on_error=False)
    command("verify-dataset", "root")
    command("recover-dataset", "root", force=False)
    command("dashboard", "path", "output", title="Test data", max_correlation_tests=16)
    command("dashboard-dir", "root", "output", title="Test data", max_correlation_tests=16, max_lots=32)
    command("traceability", "inputs+", flow_config="", mappings="", closures="", output="", scratch="", max_devices=100_000, max_sources=10_000, max_report_bytes=32 << 20)
    return top


def _show(frame, limit: int = 10_000) -> None:
    for row in frame.limit(limit).toLocalIterator():
        print("  ".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; returns its exit code, 1 for a check that found errors."""
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("dieline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from .operators.flows import read_config

    if a.command == "info":
        for frame in api.info(spark, a.path):
            _show(frame)
    elif a.command == "dump":
        for row in api.dump(spark, a.path, a.limit).toLocalIterator():
            print(row["line"])
    elif a.command in ("check", "batch-check"):
        findings, reports = api.check(spark, *([a.path] if a.command == "check" else a.inputs))
        lines = render.check_text(findings, reports)
        if a.command == "batch-check" and a.output:
            lines.select("line").write.mode("errorifexists").text(a.output)
        else:
            for row in lines.toLocalIterator():
                print(row["line"])
        return int(not reports.filter("has_errors").isEmpty())
    elif a.command == "to-ascii":
        api.to_ascii(spark, a.path, a.output)
    elif a.command == "convert":
        print(json.dumps(api.convert(spark, a.path, a.output, not a.no_overwrite, a.batch_size)))
    elif a.command == "convert-many":
        api.convert_many(spark, a.inputs, a.output, a.partition_by.split(","))
    elif a.command == "convert-partitioned":
        run = api.convert_partitioned(spark, a.inputs, a.output, a.partition_by.split(","), a.max_pending_tests, a.row_group_rows, a.max_sources, a.continue_on_error)
        print(json.dumps(run))
        return int(run["status"] != "complete")
    elif a.command == "verify-dataset":
        print(json.dumps(api.verify_dataset(spark, a.root)))
    elif a.command == "recover-dataset":
        print(json.dumps(api.recover_dataset(spark, a.root, a.force)))
    elif a.command == "dashboard":
        api.dashboard(spark, a.path, a.output, a.title, a.max_correlation_tests)
    elif a.command == "dashboard-dir":
        api.dashboard_dir(spark, a.root, a.output, a.title, a.max_correlation_tests, a.max_lots)
    elif a.command == "traceability":
        more = {k: read_config(spark, getattr(a, k)) for k in ("mappings", "closures") if getattr(a, k)}
        scratch = a.scratch
        if not scratch:
            if not spark.sparkContext.master.startswith("local"):
                raise SystemExit("--scratch must name a folder that all executors share")
            scratch = tempfile.mkdtemp(prefix="dieline-")
        api.traceability_page(spark, a.inputs, a.flow_config, a.output, f"{scratch}/runs", max_devices=a.max_devices, max_bytes=a.max_report_bytes, max_sources=a.max_sources, **more)
    return 0


if __name__ == "__main__":
    sys.exit(main())
