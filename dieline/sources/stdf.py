"""STDF files as DataFrames: discovery, records, summaries, and EAV rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import records as R

RECORDS = "source_id string, offset bigint, rec_typ int, rec_sub int, rec_len int, mnemonic string, fields string, error string"
EAV = (
    "source_id string, prr_offset bigint, ptr_offset bigint, lot_id string, wafer_id string, part_id string, head_num int, site_num int, "
    "x_coord int, y_coord int, hard_bin int, soft_bin int, part_pass boolean, test_num bigint, test_txt string, test_type string, result float, "
    "test_pass boolean, lo_limit float, hi_limit float, units string, test_time_ms bigint, part_sequence bigint, error string"
)
#: Names of STDF files, whatever their case, as a glob that keeps other files from being read.
_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in end) for end in ("stdf", "std", "stdf.gz", "std.gz")) + "}"


def find(spark: SparkSession, *places: str, max_sources: int | None = None) -> DataFrame:
    """The STDF files at or below some places, with their bytes; a file that several places hold comes once.

    The names are matched while listing, so no other file is read. More than max_sources files are an error,
    never a cut. Links are followed as the file system does; give real folders.
    """
    found = None
    for place in dict.fromkeys(places):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOB).load(place)
        found = files if found is None else found.unionByName(files)
    if found is None:
        raise ValueError("no inputs")
    found = found.dropDuplicates(["path"]) if len(set(places)) > 1 else found
    if max_sources is not None and (n := found.select("path").count()) > max_sources:
        raise ValueError(f"{n} sources; the limit is {max_sources}")
    return found


def _unpack(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        hashes, errors = [], []
        for content in b.column(1):
            raw, error = content.as_py() or b"", None
            try:
                raw = R.unpacked(raw)
            except (ValueError, EOFError, OSError) as e:
                error = str(e)
            hashes.append(hashlib.sha256(raw).hexdigest())
            errors.append(error)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], ["path", "sha256", "error"])


def hashed(files: DataFrame) -> DataFrame:
    """Path, sha256 of the unpacked bytes (of the file itself if it can't be unpacked, with the error)."""
    return files.select("path", "content").mapInArrow(_unpack, "path string, sha256 string, error string")


def distinct_contents(files: DataFrame) -> DataFrame:
    """One row per unpacked content, with all of its paths in order; a file and its gzip are one."""
    groups = hashed(files).groupBy("sha256")
    return groups.agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("copies"))


def _json(fields: dict | None) -> str | None:
    def plain(x):
        if isinstance(x, bytes):
            return x.hex()
        if isinstance(x, float) and x != x or x in (float("inf"), float("-inf")):
            return str(x)
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return None if fields is None else json.dumps({k: plain(v) for k, v in fields.items() if v is not None})


def _records(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        yield from _all_records(batches, strict)

    return run


def _all_records(batches: Iterator[pa.RecordBatch], strict: bool):
    names = ["source_id", "offset", "rec_typ", "rec_sub", "rec_len", "mnemonic", "fields", "error"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            source, rows = path.as_py(), []
            try:
                data = R.unpacked(content.as_py())
                order = R.byte_order(data, strict=strict)
                for offset, typ, sub, body in R.frames(data, order):
                    name, fields = R.parse(typ, sub, body, order)
                    rows.append((source, offset, typ, sub, len(body), name, _json(fields), None))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
            except (ValueError, EOFError, OSError) as error:
                rows.append((source, None, None, None, None, None, None, str(error)))
            if rows:
                yield batch(rows)


def read_records(files: DataFrame, strict: bool = True) -> DataFrame:
    """Every record of every file (path, content); a file that can't be read further ends with an error row.

    Without strict, the version in the FAR isn't looked at (F3).
    """
    return files.select("path", "content").mapInArrow(_records(strict), RECORDS)


def summary(found: DataFrame) -> DataFrame:
    """Records of each type by file, by the type in the header, also of bodies that could not be read."""
    return found.filter("error IS NULL").groupBy("source_id", "mnemonic").agg(F.count("*").alias("records"))


def info(found: DataFrame) -> DataFrame:
    """for each file its records, byte order, bytes consumed, whether it is cut off, and its errors."""
    far = F.get_json_object("fields", "$.cpu_type").cast("int")
    cpu = F.max(F.when(F.col("offset") == 0, far))
    end = F.max(F.col("offset") + 4 + F.col("rec_len"))
    return found.groupBy("source_id").agg(
        F.count("mnemonic").alias("records"), F.when(cpu == 2, "little").when(cpu == 1, "big").alias("byte_order"),
        F.coalesce(end, F.lit(0)).alias("bytes_consumed"), F.coalesce(F.bool_or(F.col("error").contains("cut off")), F.lit(False)).alias("truncated"),
        F.max("error").alias("error"),
    )


def record_stream(found: DataFrame) -> DataFrame:
    """The stream that the conformance rules read, from records."""
    shape = (
        "head_num int, site_num int, site_grp int, lot_id string, test_num bigint, test_txt string, opt_flag int, lo_limit float, hi_limit float, "
        "hard_bin int, hbin_num int, hbin_cnt bigint"
    )
    f = F.from_json("fields", shape)
    rows = found.filter("error IS NULL").select("source_id", "offset", F.when(F.col("fields").isNotNull(), F.col("mnemonic")).otherwise("UNKNOWN").alias("mnemonic"), f.alias("f"))
    place = F.when(F.col("mnemonic").isin("WIR", "WRR"), F.col("f.site_grp")).otherwise(F.col("f.site_num"))
    return rows.select(
        "source_id", "offset", "mnemonic", "f.head_num", place.alias("site_num"), "f.lot_id", "f.test_num", "f.test_txt", "f.opt_flag", "f.lo_limit", "f.hi_limit",
        F.coalesce("f.hard_bin", "f.hbin_num").alias("bin"), F.col("f.hbin_cnt").alias("count"),
    )


class Assembly:
    """Attempts of parts from a file's records, in order of completion.

    A PIR opens an attempt of its head and site, as does a test or a PRR without one; a second PIR
    replaces an open attempt; a PRR closes it. Lot and wafer are those at the opening. Attempts that are open
    at the end are dropped.

    In strict mode (X9) that is an error, as are a replaced attempt, tests of other kinds than PTR, known
    records that can't be read, texts of more than 255 bytes that go into rows, and more than max_pending open tests.
    """

    def __init__(self, reset_on_mir: bool = False, strict: bool = False, max_pending: int = 100_000):
        self.lot, self.count, self.reset_on_mir = "", 0, reset_on_mir
        self.strict, self.max_pending, self.pending = strict, max_pending, 0
        self.wafers: dict[tuple[int, int], str | None] = {}
        self.groups: dict[tuple[int, int], int] = {}
        self.open: dict[tuple[int, int], dict] = {}

    def wafer(self, head: int, site: int) -> str | None:
        group = self.groups.get((head, site))
        for key in [(head, group)] * (group is not None) + [(head, 255)]:
            if key in self.wafers:
                return self.wafers[key]
        on_head = [w for (h, _), w in self.wafers.items() if h == head]
        return on_head[0] if len(on_head) == 1 else None

    def start(self, key: tuple[int, int]) -> dict:
        self.count += 1
        self.open[key] = part = {"lot": self.lot, "wafer": self.wafer(*key), "sequence": self.count, "tests": []}
        return part

    def demand(self, name: str, f: dict | None, offset: int) -> None:
        """Raises what strict mode doesn't allow."""
        if f is None:
            if name != "UNKNOWN":
                raise ValueError(f"malformed {name} at {offset}")
            return
        if name in ("MPR", "FTR"):
            raise ValueError(f"{name} at {offset} would be lost")
        key = f.get("head_num"), f.get("site_num")
        if name == "PIR" and key in self.open:
            raise ValueError(f"PIR at {offset} replaces an open part")
        if name == "PTR":
            self.pending += 1
            if self.pending > self.max_pending:
                raise ValueError(f"{self.pending} pending tests at {offset}; the limit is {self.max_pending}")
        if name == "PRR" and key in self.open:
            self.pending -= len(self.open[key]["tests"])
        for field in ("lot_id", "wafer_id", "part_id", "test_txt", "units"):
            if len((f.get(field) or "").encode()) > 255:
                raise ValueError(f"{field} at {offset} is too long")

    def end(self) -> None:
        if self.strict and self.open:
            raise ValueError(f"{len(self.open)} parts without PRR at the end")

    def push(self, name: str, f: dict, offset: int) -> tuple[dict, dict] | None:
        """Takes a record; returns an attempt and its PRR when that closes it."""
        if name == "MIR":
            self.lot = f["lot_id"]
            if self.reset_on_mir:
                self.wafers.clear(), self.groups.clear()
        elif name == "SDR":
            for site in f["site_num"]:
                self.groups[f["head_num"], site] = f["site_grp"]
        elif name in ("WIR", "WRR"):
            key = f["head_num"], 255 if f["site_grp"] is None else f["site_grp"]
            if name == "WIR":
                self.wafers[key] = f["wafer_id"]
            else:
                self.wafers.pop(key, None)
        elif name in ("PIR", "PTR", "PRR"):
            key = f["head_num"], f["site_num"]
            if name == "PIR":
                self.start(key)
            else:
                part = self.open.get(key) or self.start(key)
                if name == "PTR":
                    part["tests"].append((offset, f))
                else:
                    return self.open.pop(key), f
        return None


def _eav(strict: bool, max_pending: int, batch_rows: int):
    columns = [c.split() for c in EAV.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "float": pa.float32()}

    def batch(rows):
        arrays = [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in columns])

    def rows_of(source, part, p, offset):
        part_id = f"H{p['head_num']}_S{p['site_num']}_P{part['sequence']}" if p["part_id"] is None else p["part_id"]
        for at, t in part["tests"]:
            valid = not t["test_flg"] & 0x40
            yield (
                source, offset, at, part["lot"], part["wafer"], part_id, p["head_num"], p["site_num"], p["x_coord"], p["y_coord"],
                p["hard_bin"], p["soft_bin"], not p["part_flg"] & 0x18, t["test_num"], t["test_txt"], "PTR", t["result"],
                not t["test_flg"] & 0x80 if valid else None, t["lo_limit"], t["hi_limit"], t["units"], p["test_t"], part["sequence"], None,
            )

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                source, rows, state = path.as_py(), [], Assembly(strict=strict, max_pending=max_pending)
                try:
                    data = R.unpacked(content.as_py())
                    order = R.byte_order(data)
                    for offset, typ, sub, body in R.frames(data, order):
                        name, f = R.parse(typ, sub, body, order)
                        if strict:
                            state.demand(name, f, offset)
                        done = state.push(name, f, offset) if f is not None else None
                        if done is not None:
                            rows += rows_of(source, *done, offset)
                        if len(rows) >= max(batch_rows, 1):
                            yield batch(rows)
                            rows = []
                    state.end()
                except (ValueError, EOFError, OSError) as error:
                    rows.append((source, *[None] * (len(columns) - 2), str(error)))
                if rows:
                    yield batch(rows)

    return run


def read_rows(files: DataFrame, strict: bool = False, max_pending: int = 100_000, batch_rows: int = 10_000) -> DataFrame:
    """One row per test of each completed attempt, whole parts to a batch of about batch_rows rows.

    A file that can't be read further, or that strict mode refuses, ends with a row that has an error only; all
    other files are whole. Save the rows before reading both parts of sorted_out().
    """
    return files.select("path", "content").mapInArrow(_eav(strict, max_pending, batch_rows), EAV)


def sorted_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T4: the rows of files without errors, and the errors (source_id, error)."""
    bad = rows.filter("error IS NOT NULL").select("source_id", "error")
    good = rows.filter("error IS NULL").drop("error").join(bad.select("source_id").distinct(), "source_id", "left_anti")
    return good.select(*(c for c in rows.columns if c != "error")), bad


def read_eav(files: DataFrame, strict: bool = False, **options) -> DataFrame:
    """read_rows() with identity. Lenient reading keeps what comes before an error; in strict mode an error fails the job."""
    rows = read_rows(files, strict, **options)
    if strict:
        broken = F.raise_error(F.concat("source_id", F.lit(": "), "error")).cast("boolean")
        rows = rows.filter(F.when(F.col("error").isNotNull(), broken).otherwise(True))
    return identified(rows.filter("error IS NULL").drop("error"))


def identified(rows: DataFrame) -> DataFrame:
    """X7 with the identity of X's attempts.

    Everything after the assembly is relational. source_id, prr_offset and ptr_offset give the order of arrival.
    """
    spot = E.axis(F.coalesce("test_txt", F.lit("")))
    rows = rows.withColumn("spot", spot).withColumn("place", E.positive_integer(F.col("result")))
    attempt = ["source_id", "part_sequence"]
    named = rows.filter("spot IS NOT NULL").groupBy(*attempt, "spot.axis", "spot.rank").agg(
        F.count("*").alias("n"), F.count("place").alias("valid"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    top = named.groupBy(*attempt, "axis").agg(F.max_by(F.struct("n", "valid", "low", "high"), "rank").alias("t"))
    agreed = F.when((F.col("t.n") == F.col("t.valid")) & (F.col("t.low") == F.col("t.high")), F.col("t.low"))
    axes = top.groupBy(*attempt).agg(F.max(F.when(F.col("axis") == "x", agreed)).alias("px"), F.max(F.when(F.col("axis") == "y", agreed)).alias("py"))
    rows = rows.drop("spot", "place").join(axes, attempt, "left")
    key = F.coalesce(E.wafer_key(F.col("wafer_id"), F.col("x_coord"), F.col("y_coord")), E.lot_key(F.col("lot_id"), F.col("px"), F.col("py")))
    rows = rows.withColumn("part_merge_key", key).drop("px", "py")
    rows = rows.withColumn("part_key", E.scoped_part_key(F.col("part_merge_key"), F.col("source_id"), F.col("part_sequence")))
    return rows.withColumn("obs_ord", F.struct("source_id", "prr_offset", "ptr_offset"))
