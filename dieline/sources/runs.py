"""Test runs and attempts with their evidence, from STDF files.

One pass over the files gives rows of three kinds, which attempts(), runs() and errors() tell apart: save
the rows first if more than one kind is needed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import records as R
from .stdf import Assembly

#: The hardware fields of an SDR, and the MIR fields by which steps are selected.
HARDWARE = tuple(f"{a}_{b}" for a in ("hand", "card", "load", "dib", "cabl", "cont", "lasr", "extr") for b in ("typ", "id"))
PROGRAM = ("job_nam", "job_rev", "test_cod", "flow_id", "tst_temp")

ROWS = (
    "kind string, source string, run string, offset bigint, sequence bigint, lot string, wafer string, prr_x int, prr_y int, head int, site int, part_id string, "
    "part_flg int, raw_hard_bin int, raw_soft_bin int, hardware map<string,string>, axes array<struct<name:string,result:float>>, "
    "program map<string,string>, start bigint, finish bigint, mir string, error string"
)
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()),
    "array<struct<name:string,result:float>>": pa.list_(pa.struct([("name", pa.string()), ("result", pa.float32())])),
}
_COLUMNS = [c.split(" ", 1) for c in ROWS.replace(", ", "\n").replace("name:string,result", "name:string,result").split("\n")]


class RunAssembly(Assembly):
    """Attempts of a file whose runs are each delimited by a MIR and an MRR; anything else is an error.

    Wafers and sites are forgotten at each MIR. A PRR without a PIR is an attempt of its own.
    """

    def __init__(self, source: str):
        super().__init__(reset_on_mir=True)
        self.source, self.number, self.run, self.program = source, 0, None, {}
        self.hardware: dict[tuple[int, int], dict] = {}

    def take(self, name: str, f: dict | None, offset: int) -> dict | None:
        """Takes a record; returns the row that it completes."""
        if f is None:
            if name != "UNKNOWN":
                raise ValueError(f"malformed {name} at {offset}")
            return None
        if name == "MIR":
            if self.run is not None or self.open:
                raise ValueError("MIR before closing prior run/parts")
            self.hardware.clear()
            self.number += 1
            self.run = f"{self.source}:{self.number}"
            self.mir = f
        elif name == "MRR":
            if self.open:
                raise ValueError("MRR with unclosed test instances")
            if self.run is None:
                raise ValueError("MRR without MIR")
            mir, run, self.run = self.mir, self.run, None
            return {
                "kind": "run", "source": self.source, "run": run, "program": [(k, mir.get(k)) for k in PROGRAM],
                "start": mir["start_t"] or None, "finish": f["finish_t"] or None, "mir": json.dumps(mir),
            }
        elif name == "SDR":
            for site in f["site_num"]:
                self.hardware[f["head_num"], site] = {k: f[k] for k in HARDWARE}
        elif name in ("PIR", "PRR") and self.run is None:
            raise ValueError(f"{name} outside MIR/MRR run")
        key = (f.get("head_num"), f.get("site_num"))
        if name == "PIR" and key in self.open:
            raise ValueError("PIR replaces an unclosed test instance")
        if name in ("PTR", "MPR", "FTR") and key not in self.open:
            raise ValueError(f"{name} without matching head/site PIR")
        done = self.push(name, f, offset)
        if done is None:
            return None
        part, p = done
        return {
            "kind": "attempt", "source": self.source, "run": self.run, "offset": offset, "sequence": part["sequence"], "lot": self.lot, "wafer": part["wafer"],
            "prr_x": p["x_coord"], "prr_y": p["y_coord"], "head": p["head_num"], "site": p["site_num"], "part_id": p["part_id"], "part_flg": p["part_flg"],
            "raw_hard_bin": p["hard_bin"], "raw_soft_bin": p["soft_bin"], "hardware": list(part.get("hardware", {}).items()),
            "axes": [{"name": t["test_txt"], "result": t["result"]} for _, t in part["tests"] if t["test_txt"] and ("x" in t["test_txt"].lower() or "y" in t["test_txt"].lower())],
        }

    def start(self, key: tuple[int, int]) -> dict:
        part = super().start(key)
        part["hardware"] = self.hardware.get(key, {})
        return part

    def end(self) -> None:
        if self.open:
            raise ValueError("unclosed test instances at EOF")
        if self.run is not None:
            raise ValueError("unclosed STDF run at EOF (missing MRR)")
        if not self.number:
            raise ValueError("input has no MIR run")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in _COLUMNS], [n for n, _ in _COLUMNS])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(1):
            rows: list[dict] = []
            raw = content.as_py()
            source = hashlib.sha256(raw).hexdigest()
            try:
                data = R.unpacked(raw)
                source = hashlib.sha256(data).hexdigest()
                order, state = R.byte_order(data), RunAssembly(source)
                for offset, typ, sub, body in R.frames(data, order):
                    row = state.take(*R.parse(typ, sub, body, order), offset)
                    if row is not None:
                        rows.append(row)
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
                state.end()
            except (ValueError, EOFError, OSError) as error:
                rows.append({"kind": "error", "source": source, "error": str(error)})
            if rows:
                yield _batch(rows)


def read_runs(files: DataFrame) -> DataFrame:
    """Rows of attempts, runs and errors of files (path, content); a source is the SHA-256 of its unpacked bytes."""
    return files.select("path", "content").mapInArrow(_read, ROWS)


def errors(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'error'").select("source", "error")


def runs(rows: DataFrame) -> DataFrame:
    """One row per run; times of 0 are unknown."""
    return rows.filter("kind = 'run'").select("run", "source", "program", "start", "finish", "mir")


def attempts(rows: DataFrame) -> DataFrame:
    """One row per PRR with its verdict, valid bins, and identity.

    The measured axes of an attempt are a few tests by their names, so they are resolved within the row: the
    highest rank of an axis counts, and all its values must agree and be positive integers.
    """
    spots = F.transform("axes", lambda a: F.struct(E.axis(a["name"]).alias("spot"), E.positive_integer(a["result"]).alias("v")))
    rows = rows.filter("kind = 'attempt'").withColumn("spots", spots)

    def place(letter: str):
        own = F.filter("spots", lambda s: s["spot"]["axis"] == letter)
        top = F.array_max(F.transform(own, lambda s: s["spot"]["rank"]))
        values = F.array_distinct(F.transform(F.filter(own, lambda s: s["spot"]["rank"] == top), lambda s: s["v"]))
        return F.when(F.size(values) == 1, values[0])

    flag = F.col("part_flg")
    rows = rows.withColumn("px", place("x")).withColumn("py", place("y"))
    key = F.coalesce(E.wafer_key(F.col("wafer"), F.col("prr_x"), F.col("prr_y")), E.lot_key(F.col("lot"), F.col("px"), F.col("py")))
    return rows.select(
        "source", "run", "offset", "sequence", key.alias("original_identity"), "lot", "wafer", "prr_x", "prr_y", "head", "site", "part_id", "part_flg",
        E.traced_passed(flag).alias("passed"), E.valid_bin(F.col("raw_hard_bin")).alias("hard_bin"), E.valid_bin(F.col("raw_soft_bin")).alias("soft_bin"),
        "raw_hard_bin", "raw_soft_bin", "hardware",
    )
