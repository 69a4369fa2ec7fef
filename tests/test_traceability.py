"""Runs and evidence from STDF files, and the conditions of flows, mappings and closures."""

import json
import struct

import pytest

from dieline import api
from dieline.operators import flows
from dieline.operators import traceability as T
from dieline.sources import runs
from dieline.sources.records import frame

FLOW = {"flow_id": "F", "version": "1", "steps": [
    {"id": "A", "required": True, "stop_on_fail": True, "matches": [{"job_nam": "JA"}]},
    {"id": "B", "required": True, "matches": [{"job_nam": "JB"}]},
    {"id": "C", "required": False, "matches": [{"job_nam": "JC"}]},
]}


def text(x):
    return bytes([len(x)]) + x.encode()


def rec(typ, sub, code, *values, tail=b""):
    return frame(typ, sub, struct.pack("<" + code, *values) + tail)


def run_bytes(job, start, finish, parts, lot="L"):
    """A run; a part is (x, y, flag, bin) on wafer W1, or a list of (name, value) tests and (flag, bin) without wafer coordinates."""
    out = [rec(0, 10, "BB", 2, 4), rec(1, 10, "IIBBBBHB", 0, start, 1, 80, 32, 32, 0, 32, tail=b"".join(map(text, (lot, "T", "N", "S", job))))]
    out.append(rec(1, 80, "BBBB", 1, 9, 1, 0, tail=text("HT") + text("H1")))
    out.append(rec(2, 10, "BBI", 1, 9, 0, tail=text("W1")))
    for p in parts:
        out.append(rec(5, 10, "BB", 1, 0))
        if isinstance(p[0], list):
            tests, flag, bin_ = p
            out += [rec(15, 10, "IBBBBf", 1, 1, 0, 0, 0, v, tail=text(n)) for n, v in tests]
            x = y = -32768
        else:
            x, y, flag, bin_ = p
        out.append(rec(5, 20, "BBBHHHhhI", 1, 0, flag, 0, bin_, 1, x, y, 0, tail=text("P")))
    return b"".join([*out, rec(1, 20, "I", finish)])


def trace(spark, files, **more):
    df = spark.createDataFrame([(f"f{i}", f) for i, f in enumerate(files)], "path string, content binary")
    rows = runs.read_runs(df)
    assert runs.errors(rows).collect() == []
    attempts, flow = runs.attempts(rows), flows.Flow.parse(FLOW)
    issues, dense = T.trace(attempts, runs.runs(rows), flow, **more)
    cells = {(r.device, r.step_id): r for r in dense.collect()}
    return {r.device: r for r in issues.collect()}, cells


KEY = '["wafer-prr","W1",%d,%d]'


def test_retests_and_order(spark):
    issues, cells = trace(spark, [run_bytes("JA", 10, 20, [(1, 1, 0, 1)]), run_bytes("JA", 30, 40, [(1, 1, 8, 2)]), run_bytes("JA", 50, 60, [(1, 1, 0, 1)])])
    c = cells[KEY % (1, 1), "A"]
    assert (c.tests, c.retests, c.verdict_changed, c.latest_passed, c.order_unknown, c.status) == (3, 2, True, True, False, "retest_different")
    assert issues[KEY % (1, 1)].issues == ["retest_different"]
    # a run that starts before another source's ends, and one that starts when it ends
    for start in (15, 20):
        _, cells = trace(spark, [run_bytes("JA", 10, 20, [(1, 1, 0, 1)]), run_bytes("JA", start, 60, [(1, 1, 8, 1)])])
        assert cells[KEY % (1, 1), "A"].order_unknown and cells[KEY % (1, 1), "A"].latest_passed is None
    # a long earlier run overlaps although the one just before doesn't
    _, cells = trace(spark, [run_bytes("JA", 10, 100, [(1, 1, 0, 1)]), run_bytes("JA", 101, 102, [(1, 1, 0, 1)]), run_bytes("JA", 0, 5, [(1, 1, 0, 1)])])
    assert cells[KEY % (1, 1), "A"].order_unknown
    both = run_bytes("JA", 10, 100, [(1, 1, 0, 1)]) + run_bytes("JA", 12, 13, [(1, 1, 8, 1)])[6:]
    _, cells = trace(spark, [both])
    assert not cells[KEY % (1, 1), "A"].order_unknown and cells[KEY % (1, 1), "A"].latest_passed is False


def test_statuses(spark):
    good = run_bytes("JA", 1, 2, [(1, 1, 0, 1), (1, 2, 8, 1), (1, 3, 0, 40000), (1, 4, 0, 1)])
    later = run_bytes("JB", 5, 6, [(1, 1, 0, 1), (2, 2, 0, 1)], "M")
    lots = spark.createDataFrame([("L",)], "lot string")
    issues, cells = trace(spark, [good, later], lots=lots)
    status = lambda x, y: [cells[KEY % (x, y), s].status for s in "ABC"]
    assert status(1, 1) == ["tested", "tested", "not_applicable"] and status(1, 2) == ["tested", "not_applicable", "not_applicable"]
    assert status(1, 3) == ["indeterminate", "indeterminate", "not_applicable"] and status(1, 4) == ["tested", "missing", "not_applicable"]
    assert status(2, 2) == ["missing", "tested", "not_applicable"]
    assert issues[KEY % (1, 3)].issues == ["result_incomplete"] and issues[KEY % (1, 4)].closed and not issues[KEY % (2, 2)].closed
    assert issues[KEY % (1, 1)].lots == ["L", "M"]
    _, cells = trace(spark, [good])
    assert cells[KEY % (1, 4), "B"].status == "pending"


def test_identities(spark):
    tests = [("DIE_X", 3.0), ("DIE_Y", 4.0)]
    parts = [(tests, 0, 1), ([("DIE_X", 3.0), ("DIE_X", 2.0), ("DIE_Y", 4.0)], 0, 1), ([("DIE_X", 3.5), ("DIE_Y", 4.0)], 0, 1)]
    content = run_bytes("JA", 1, 2, parts)
    issues, cells = trace(spark, [content])
    fallback = '["lot-ptr","L",3,4]'
    assert issues[fallback].issues == ["fallback_unlinked"] and cells[fallback, "B"].status == "indeterminate"
    assert sorted(d.startswith("unresolved:") for d in issues) == [False, True, True]
    aliases = flows.parse_mappings([{"from": ["lot-ptr", "L", 3, 4], "to": ["wafer-prr", "W9", 3, 4]}])
    issues, _ = trace(spark, [content], aliases=flows.alias_table(spark, aliases), keys=spark.createDataFrame([('["wafer-prr","W9",3,4]',)], "device string"))
    assert issues['["wafer-prr","W9",3,4]'].issues == ["missing"] and issues['["wafer-prr","W9",3,4]'].closed
    issues, _ = trace(spark, [run_bytes("other", 1, 2, [(1, 1, 0, 1)])])
    assert issues[KEY % (1, 1)].issues == ["step_unidentified"]


@pytest.mark.parametrize("content,message", [
    (run_bytes("JA", 1, 2, [])[6:], "FAR"), (run_bytes("JA", 1, 2, [])[:-8], "missing MRR"), (run_bytes("JA", 1, 2, [])[:-8] + rec(5, 10, "BB", 1, 0), "unclosed test"),
    (rec(0, 10, "BB", 2, 4), "no MIR"), (rec(0, 10, "BB", 2, 4) + rec(5, 10, "BB", 1, 0), "outside"), (run_bytes("JA", 1, 2, [])[:-8] + run_bytes("JA", 1, 2, [])[6:], "MIR before"),
    (run_bytes("JA", 1, 2, [])[:-8] + rec(15, 10, "IBBBBf", 1, 1, 0, 0, 0, 1.0), "without matching"), (run_bytes("JA", 1, 2, []) + rec(1, 20, "I", 1), "MRR without"),
    (run_bytes("JA", 1, 2, [])[:-8] + rec(5, 10, "BB", 1, 0) * 2, "replaces"), (run_bytes("JA", 1, 2, [])[:-8] + rec(5, 10, "B", 1), "malformed"), (run_bytes("JA", 1, 2, [])[:-3], "cut off"),
])
def test_broken_runs(spark, content, message):
    df = spark.createDataFrame([("bad", content), ("good", run_bytes("JA", 1, 2, [(1, 1, 0, 1)]))], "path string, content binary")
    rows = runs.read_runs(df)
    (error,) = runs.errors(rows).collect()
    assert message in error.error and runs.attempts(rows).filter(f"source <> '{error.source}'").count() == 1


def test_configurations():
    flow = flows.Flow.parse(FLOW)
    for change in ({"x": 1}, {"steps": []}, {"flow_id": ""}, {"steps": [FLOW["steps"][0]] * 2}, {"steps": [{"id": "A", "required": True, "matches": [{}]}]}):
        with pytest.raises((ValueError, KeyError)):
            flows.Flow.parse(FLOW | change)
    for bad in (["wafer-prr", "w1", 1, 1], ["wafer-prr", "W1", 0, 1], ["wafer-prr", "W1", 40000, 1], ["x", "W1", 1, 1], ["lot-ptr", "", 1, 1]):
        with pytest.raises(ValueError):
            flows.identity_key(bad)
    one, two, other = ["lot-ptr", "L", 1, 1], ["wafer-prr", "W", 1, 1], ["wafer-prr", "W", 2, 1]
    for rows in ([{"from": two, "to": two}], [{"from": one, "to": two}, {"from": one, "to": other}]):
        with pytest.raises(ValueError):
            flows.parse_mappings(rows)
    aliases = flows.parse_mappings([{"from": one, "to": two}] * 2)
    base = {"flow_id": "F", "version": "1"}
    assert flows.parse_closures([base | {"lot": "L"}, base | {"device": one}], flow, aliases) == (["L"], ['["wafer-prr","W",1,1]'])
    for row in (base, base | {"lot": ""}, base | {"lot": "L", "device": one}, {"flow_id": "G", "version": "1", "lot": "L"}):
        with pytest.raises(ValueError):
            flows.parse_closures([row], flow, aliases)


def test_page(spark, tmp_path):
    (tmp_path / "a.stdf").write_bytes(run_bytes("JA", 1, 2, [(1, 1, 0, 1), (1, 2, 8, 1)]))
    (tmp_path / "copy.stdf").write_bytes((tmp_path / "a.stdf").read_bytes())
    (tmp_path / "flow.json").write_text(json.dumps(FLOW))
    where = dict(inputs=[str(tmp_path)], flow_path=str(tmp_path / "flow.json"), output=str(tmp_path / "t.html"))
    api.traceability_page(spark, scratch=str(tmp_path / "w"), **where)
    payload = json.loads((tmp_path / "t.html").read_text().split('id="data">')[1].split("</script>")[0])["traceability-v1"]
    assert payload["totals"][0]["devices"] == 2 and payload["totals"][0]["tests"] == 2 and len(payload["devices"][0]["steps"]) == 3
    with pytest.raises(ValueError, match="devices"):
        api.traceability_page(spark, scratch=str(tmp_path / "v"), max_devices=1, **where)
    with pytest.raises(ValueError, match="bytes"):
        flows.read_config(spark, str(tmp_path / "flow.json"), 10)
