"""The public functions over files: what the command line does, for use from Python (API1-API14)."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render
from .operators import analytics, flows, traceability, validation
from .sources import runs as run_source
from .sources import stdf, storage

TABLES = {
    "kpis": analytics.kpis,
    "pareto": analytics.pareto,
    "wafer_yield": analytics.wafer_yield,
    "site_yield": analytics.site_yield,
    "hard_bins": analytics.hard_bins,
    "soft_bins": analytics.soft_bins,
    "commonality": analytics.commonality,
    "correlations": analytics.correlations,
    "heatmap_points": analytics.xy_map,
    "process_windows": analytics.process_windows,
    "data_quality": analytics.data_quality,
}


def _records(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return stdf.read_records(stdf.find(spark, *paths))


def info(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """API1: a summary of each file, and its records by type."""
    found = _records(spark, paths)
    return stdf.info(found), stdf.summary(found)


def dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """API2: a line for each record."""
    return render.dump(_records(spark, [path]), limit)


def check(spark: SparkSession, *paths: str, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """API3, API5: findings, and a report for each file. With a scratch folder, files are decoded once and not for each rule."""
    found = _records(spark, paths)
    if scratch:
        found.write.mode("overwrite").parquet(scratch)
        found = spark.read.schema(found.schema).parquet(scratch)
    findings = validation.check(stdf.record_stream(found))
    return findings, validation.report(findings, found.select("source_id").distinct(), found.filter("error IS NOT NULL").select("source_id"))


def to_ascii(spark: SparkSession, path: str, output: str) -> None:
    """API4."""
    render.write_ascii(_records(spark, [path]), output)


def convert(spark: SparkSession, path: str, output: str, overwrite: bool = True, batch_rows: int = 10_000) -> dict:
    """API6: one or more files as one folder of EAV rows; returns its totals."""
    return storage.write_eav(spark, stdf.read_eav(stdf.find(spark, path), batch_rows=batch_rows), output, overwrite)


def convert_many(spark: SparkSession, inputs: Iterable[str], output: str, partition_by: Iterable[str]) -> None:
    """API7, K4: files in folders by keys of which each file has one value."""
    rows = stdf.read_eav(stdf.find(spark, *inputs))
    storage.partitioned(storage.homogeneous(rows, partition_by), output, partition_by)


def convert_partitioned(
    spark: SparkSession, inputs: Iterable[str], output: str, keys: Iterable[str] = storage.KEYS, max_pending: int = 100_000, rows_per_file: int = 65_536,
    max_sources: int | None = 10_000, continue_on_error: bool = False,
) -> dict:
    """API8: files into a catalog, strictly assembled; files whose content and options the catalog has are not decoded again."""
    catalog = storage.Catalog(spark, output)
    options = {"keys": [k.replace("-", "_") for k in keys], "rows_per_file": rows_per_file, "max_pending": max_pending}
    files = stdf.find(spark, *inputs, max_sources=max_sources)
    hashes = {r["path"]: r["sha256"] for r in stdf.hashed(files).collect()}  # at most max_sources

    def sources():
        for path, sha in sorted(hashes.items()):
            own = stdf.find(spark, path)
            yield path, sha, stdf.read_eav(own, strict=True, max_pending=max_pending)

    def digest(path: str) -> str:
        return stdf.hashed(stdf.find(spark, path)).first()["sha256"]

    return catalog.convert(sources(), options, continue_on_error, digest)


def verify_dataset(spark: SparkSession, root: str) -> dict:
    """API9."""
    return storage.Catalog(spark, root).verify()


def recover_dataset(spark: SparkSession, root: str, force: bool = False) -> list[str]:
    """API9."""
    return storage.Catalog(spark, root).recover(force)


def _keyed(rows: DataFrame) -> DataFrame:
    from .functions import expressions as E

    source = F.col("source_id") if "source_id" in rows.columns else F.lit("")
    return rows.withColumn("part_key", E.scoped_part_key(F.col("part_merge_key"), source, F.col("part_sequence")))


def _ordered(name: str, rows: list[dict]) -> list[dict]:
    """Rows of yields by fail, yield and label; of the map by place; of quality by label."""
    if name in ("wafer_yield", "site_yield", "hard_bins", "soft_bins"):
        return sorted(rows, key=lambda r: (-r["fail"], r["yield_percent"], r["label"]))
    if name == "heatmap_points":
        return sorted(rows, key=lambda r: (r["x"], r["y"]))
    return sorted(rows, key=lambda r: r["label"]) if name == "data_quality" else rows


def tables(rows: DataFrame, max_correlation_tests: int = 16, by: tuple = (), max_rows: int = 200_000) -> dict:
    """The dashboard's tables as rows; with by, of each group. A table of more than max_rows rows is refused."""
    rows, out = _keyed(rows), {}
    for name, operator in TABLES.items():
        more = {"max_tests": max(max_correlation_tests, 2)} if name == "correlations" else {}
        found = [r.asDict() for r in operator(rows, by=by, **more).limit(max_rows + 1).collect()]
        if len(found) > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows")
        out[name] = found
    return out


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    folder, _, name = path.rpartition("/")
    storage.Files(spark, folder or ".").write(name, text)


def dashboard(spark: SparkSession, eav_path: str, output: str, title: str = "Test data", max_correlation_tests: int = 16) -> None:
    """API10, K8: the tables of a folder of EAV rows as one page, replaced atomically."""
    found = tables(storage.read_eav(spark, eav_path), max_correlation_tests)
    _write_text(spark, output, render.page(title, {"all": {k: _ordered(k, v) for k, v in found.items()}}))


def dashboard_dir(spark: SparkSession, root: str, output: str, title: str = "Test data", max_correlation_tests: int = 16, max_lots: int = 32) -> None:
    """API11, A13, P16: the tables of a dataset's current rows, over all lots and for each lot."""
    catalog = storage.Catalog(spark, root)
    catalog.guard(output)
    catalog.verify()
    rows = catalog.rows()
    lots = [r[0] for r in rows.select("lot_id").distinct().limit(max_lots + 1).collect()]
    if len(lots) > max_lots:
        raise ValueError(f"more than {max_lots} lots")
    payload = {"all": {k: _ordered(k, v) for k, v in tables(rows, max_correlation_tests).items()}} | {f"lot {lot}": {} for lot in sorted(lots)}
    for name, found in tables(rows, max_correlation_tests, by=("lot_id",)).items():
        for r in found:
            payload[f"lot {r['lot_id']}"].setdefault(name, []).append({k: v for k, v in r.items() if k != "lot_id"})
    for scope, own in payload.items():
        payload[scope] = {k: _ordered(k, v) for k, v in own.items()}
    document = catalog.load()
    payload["run"] = {"status": [{"revision": document["revision"], **{k: str(v) for k, v in (document["run"] or {}).items()}}]}
    _write_text(spark, output, render.page(title, payload))


def traced(
    spark: SparkSession, inputs: Iterable[str], flow: dict, scratch: str, mappings: Iterable[dict] = (), closures: Iterable[dict] = (), max_sources: int = 10_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """API12: issues and steps of all devices, and attempts with their runs. Content that several files hold counts once; a bad file is an error."""
    plan = flows.Flow.parse(flow)
    aliases = flows.parse_mappings(list(mappings))
    lots, keys = flows.parse_closures(list(closures), plan, aliases)
    files = stdf.find(spark, *inputs, max_sources=max_sources)
    first = stdf.distinct_contents(files).select(F.col("paths")[0].alias("path"))
    run_source.read_runs(files.join(first, "path", "left_semi")).write.mode("overwrite").parquet(scratch)
    rows = spark.read.parquet(scratch)
    bad = run_source.errors(rows).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['source']}: {bad[0]['error']}")
    known = flows.alias_table(spark, aliases) if aliases else None
    attempts = traceability.placed(traceability.resolved(run_source.attempts(rows), known), run_source.runs(rows), plan)
    table = traceability.devices(
        attempts, spark.createDataFrame([(x,) for x in lots], "lot string") if lots else None, spark.createDataFrame([(x,) for x in keys], "device string") if keys else None
    )
    dense = traceability.matrix(table, traceability.cells(traceability.chronological(attempts)), plan)
    return traceability.issues(table, dense), dense, attempts


def traceability_page(spark: SparkSession, inputs: Iterable[str], flow_path: str, output: str, scratch: str, title: str = "Traceability", max_devices: int = 100_000, max_bytes: int = 32 << 20, **options) -> None:
    """API12, K9, R9: the evidence as one page; more devices or bytes than allowed are an error, never a cut."""
    issues, dense, attempts = traced(spark, inputs, flows.read_config(spark, flow_path), scratch, **options)
    if issues.limit(max_devices + 1).count() > max_devices:
        raise ValueError(f"more than {max_devices} devices")
    rows = [json.loads(r["evidence"]) for r in traceability.evidence(issues, dense, attempts).collect()]
    head = [r.asDict() for r in traceability.totals(issues, dense).collect()]
    _write_text(spark, output, render.page(title, {"traceability-v1": {"totals": head, "devices": rows}}, max_bytes))


def read_batches(spark: SparkSession, path: str) -> list[pa.RecordBatch]:
    """API13, K12: a file's EAV rows as Arrow batches."""
    return storage.stored(stdf.read_eav(stdf.find(spark, path))).toArrow().to_batches()


write_parquet = convert
write_parquet_many = convert_many
write_parquet_partitioned = convert_partitioned
