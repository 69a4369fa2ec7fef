"""Open structures at the end of files, held against a sequential count."""

from dieline.operators import validation as V


def test_aborted(spark):
    kinds = ["WRR", "WIR", "WIR", "WRR", "EPS", "BPS", "PIR", "PIR", "PRR", "PIR"]
    rows = [("a", k, m, 1, 0) for k, m in enumerate(kinds)] + [("b", 0, "MRR", None, None), ("b", 1, "PIR", 1, 3), ("b", 2, "PRR", 1, 3)]
    stream = spark.createDataFrame(rows, "source_id string, offset bigint, mnemonic string, head_num int, site_num int")
    found = {(r.source_id, r.rule, r.offset) for r in V.aborted(stream).collect()}
    assert found == {("a", "ABORT/NO_MRR", None), ("a", "ABORT/OPEN_WIR", 9), ("a", "ABORT/OPEN_PIR", 9), ("a", "ABORT/OPEN_BPS", None)}


def test_bin_counts(spark):
    said = spark.createDataFrame([("a", 1, 1, 1, 2), ("a", 1, 1, 1, 1), ("a", 255, 255, 1, 9), ("a", 255, 0, 2, 4), ("a", 1, 1, 4, 0)], "source_id string, head_num int, site_num int, hard_bin int, count int")
    met = spark.createDataFrame([("a", 1)] * 3 + [("a", 2)] + [("a", 3)], "source_id string, hard_bin int")
    assert {r.message for r in V.bin_counts(said, met).collect()} == {
        "bin 2 HBR says 4 but PRR count is 1", "bin 3 appears in PRRs (1 times) but has no HBR record"}


def stream_of(spark, kinds, source="a", step=10):
    rows = [(source, k * step, m, 1, 0, None) for k, m in enumerate(kinds)]
    return spark.createDataFrame(rows, "source_id string, offset bigint, mnemonic string, head_num int, site_num int, lot_id string")


def test_section_balance_forgets_at_depth_0(spark):
    def found(*kinds):
        return sorted((r.offset, r.record_type, r.message) for r in V.bps_eps_balance(stream_of(spark, kinds)).collect())

    assert found("BPS", "EPS", "BPS") == [(20, "BPS", "1 BPS record(s) never closed by EPS")]
    assert found("EPS", "BPS", "BPS", "EPS") == [(0, "EPS", "EPS without matching BPS"), (10, "BPS", "1 BPS record(s) never closed by EPS")]
    assert found("BPS", "EPS", "EPS", "EPS") == [(20, "EPS", "EPS without matching BPS"), (30, "EPS", "EPS without matching BPS")]


def test_wafers_and_lots(spark):
    rows = [("a", 0, "WIR", 1, None, None), ("a", 1, "WIR", 1, 255, None), ("a", 2, "WRR", 1, 3, None), ("a", 3, "MIR", None, None, " "), ("b", 4, "MIR", None, None, "L")]
    stream = spark.createDataFrame(rows, "source_id string, offset bigint, mnemonic string, head_num int, site_num int, lot_id string")
    assert sorted((r.offset, r.record_type, r.message.split(" ")[-2:]) for r in V.wir_wrr_pairs(stream).collect()) == [
        (1, "WIR", ["by", "WRR"]), (1, "WIR", ["never", "closed"]), (2, "WRR", ["matching", "WIR"])]
    assert [(r.source_id, r.offset) for r in V.lot_id_present(stream).collect()] == [("a", 3)]
    assert V.result_present(stream).collect() == []


def test_report(spark):
    stream = stream_of(spark, ["PIR"]).unionByName(stream_of(spark, ["MRR"], "b"))
    findings = V.check(stream, {k: V.RULES[k] for k in ("STRUCT/PIR_PRR_PAIR", "ABORT")})
    errors = spark.createDataFrame([("c",)], "source_id string")
    out = {r.source_id: r for r in V.report(findings, stream.select("source_id").unionByName(errors), errors).collect()}
    assert (out["a"].error, out["a"].warning, out["a"].has_errors, out["a"].likely_aborted, out["a"].is_clean) == (2, 1, True, True, False)
    assert out["b"].is_clean and out["c"].decode_error == 1 and out["c"].has_errors and not out["c"].likely_aborted
    assert [r.offset for r in V.ordered(findings).collect()] == [0, 0, None]
