"""Configurations of test flows: steps with selectors, identity mappings, closures.

Configurations are small JSON documents of fixed shape, held on the driver and turned into expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runs import PROGRAM


def read_config(spark: SparkSession, path: str, max_bytes: int = 1 << 20):
    """A JSON document by a path that Spark reads; larger ones are refused."""
    files = spark.read.format("binaryFile").load(path).select("length", "content")
    size = files.agg(F.sum("length")).first()[0]
    if size is None or size > max_bytes:
        raise ValueError(f"{path} has {size} bytes; the limit is {max_bytes}")
    return json.loads(files.first()["content"])


def _only(given: dict, known: set[str], what: str) -> dict:
    if not isinstance(given, dict) or given.keys() - known:
        raise ValueError(f"unknown fields in {what}: {sorted(given.keys() - known) if isinstance(given, dict) else given}")
    return given


@dataclass(frozen=True)
class Step:
    id: str
    required: bool
    matches: tuple[dict, ...]
    stop_on_fail: bool = False


@dataclass(frozen=True)
class Flow:
    flow_id: str
    version: str
    steps: tuple[Step, ...] = field(default_factory=tuple)

    @classmethod
    def parse(cls, given: dict) -> Flow:
        """Names and steps are there, step ids are unique, each step has selectors, each of which names a field."""
        _only(given, {"flow_id", "version", "steps"}, "flow")
        steps = []
        for s in given["steps"]:
            _only(s, {"id", "required", "stop_on_fail", "matches"}, "step")
            selectors = tuple({k: v for k, v in _only(m, set(PROGRAM), "selector").items() if v is not None} for m in s["matches"])
            steps.append(Step(s["id"], bool(s["required"]), selectors, bool(s.get("stop_on_fail", False))))
        flow = cls(given["flow_id"], given["version"], tuple(steps))
        if not (flow.flow_id and flow.version and steps):
            raise ValueError("flow ID, version and ordered steps must be nonempty")
        ids = [s.id for s in steps]
        if len(set(ids)) < len(ids) or not all(ids) or not all(s.matches and all(s.matches) for s in steps):
            raise ValueError("step IDs must be unique/nonempty; each step needs nonempty MIR selectors")
        return flow

    def step_of(self, program: Column) -> Column:
        """The position of the only step that a run's program (a map) matches, else null."""

        def accepts(selector: dict) -> Column:
            every = F.lit(True)
            for k, v in selector.items():
                every = every & F.coalesce(program[k] == v, F.lit(False))
            return every

        def any_of(step: Step) -> Column:
            found = F.lit(False)
            for m in step.matches:
                found = found | accepts(m)
            return found

        matched = F.array_compact(F.array(*(F.when(any_of(s), F.lit(i)) for i, s in enumerate(self.steps))))
        return F.when(F.size(matched) == 1, F.element_at(matched, 1))

    def array(self) -> Column:
        """The steps as an array of structs, for a dense matrix."""
        return F.array(*(
            F.struct(F.lit(i).alias("step"), F.lit(s.id).alias("step_id"), F.lit(s.required).alias("required"), F.lit(s.stop_on_fail).alias("stop"))
            for i, s in enumerate(self.steps)
        ))


def identity_key(given: list) -> str:
    """I8: the key of an identity (namespace, id, x, y) after its validation."""
    space, name, x, y = given
    if not name or not isinstance(x, int) or not isinstance(y, int) or x <= 0 or y <= 0:
        raise ValueError("identity needs a nonempty ID and positive integer coordinates")
    upper = name.isascii() and name.isalnum() and name == name.upper()
    if space != "lot-ptr" and not (space == "wafer-prr" and upper and max(x, y) <= 32767):
        raise ValueError("invalid identity namespace, wafer ID or PRR coordinate range")
    return json.dumps([space, name, x, y], separators=(",", ":"), ensure_ascii=False)


def parse_mappings(rows: list[dict]) -> dict[str, str]:
    """Aliases from lot-ptr to wafer-prr identities; one identity has one alias."""
    found: dict[str, str] = {}
    for row in rows:
        _only(row, {"from", "to"}, "mapping")
        a, b = identity_key(row["from"]), identity_key(row["to"])
        if row["from"][0] != "lot-ptr" or row["to"][0] != "wafer-prr":
            raise ValueError("identity mappings must go from lot-ptr to wafer-prr")
        if found.setdefault(a, b) != b:
            raise ValueError("conflicting identity mapping")
    return found


def parse_closures(rows: list[dict], flow: Flow, aliases: dict[str, str]) -> tuple[list[str], list[str]]:
    """The lots and the device keys (through the aliases) that are closed."""
    lots, devices = [], []
    for row in rows:
        _only(row, {"flow_id", "version", "lot", "device"}, "closure")
        if (row["flow_id"], row["version"]) != (flow.flow_id, flow.version):
            raise ValueError("closure flow ID/version does not match configured flow")
        lot, device = row.get("lot"), row.get("device")
        if (lot is None) == (device is None) or lot == "":
            raise ValueError("closure needs exactly one nonempty lot or full device identity")
        if lot is not None:
            lots.append(lot)
        else:
            key = identity_key(device)
            devices.append(aliases.get(key, key))
    return lots, devices


def alias_table(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(aliases.items()), "original_identity string, alias string")
