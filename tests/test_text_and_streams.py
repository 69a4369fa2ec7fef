"""Text forms, the command line, the incremental source, and streams."""

import gzip
import io

import pytest

from dieline.__main__ import main
from dieline.functions import render
from dieline.plans import decoded
from dieline.sources import incremental, stdf, storage
from dieline.streaming import ingest

EVENTS = [(0, 11, "click", 3.0), (0, 12, "view", 5.0), (0, 13, "signup", 120.5), (0, 14, "error", 1.5), (1, 15, "click", 2.0)]
WHOLE, CUT = decoded.file_bytes(2, EVENTS), decoded.file_bytes(8, EVENTS)


@pytest.fixture
def folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.stdf").write_bytes(WHOLE)
    (folder / "b.STD.GZ").write_bytes(gzip.compress(CUT[:60]) + gzip.compress(CUT[60:]))
    return folder


def test_streamed_records():
    found = list(incremental.stream_records(io.BytesIO(WHOLE)))
    assert [x[1:3] for x in found][:3] == [(0, 10), (1, 10), (5, 10)] and found[0][0] == 0
    assert [x[0] for x in found] == [x[0] for x in stdf.R.frames(WHOLE, "<")]
    for data in (CUT, WHOLE[:-1], WHOLE + b"\x01\x00"):
        with pytest.raises(EOFError, match="cut off at"):
            list(incremental.stream_records(io.BytesIO(data)))
    for data in (b"", WHOLE[:3], b"\x02\x00\x00\x0a\x03\x04"):
        with pytest.raises((ValueError, EOFError)):
            list(incremental.stream_records(io.BytesIO(data)))


def test_data_source(spark, folder):
    spark.dataSource.register(incremental.StdfSource)
    rows = spark.read.format("stdf").load(str(folder))
    plain = stdf.read_records(stdf.find(spark, str(folder)))
    key = ["offset", "mnemonic", "fields"]
    assert sorted(map(tuple, rows.select(*key).fillna("").fillna(-1).collect())) == sorted(map(tuple, plain.select(*key).fillna("").fillna(-1).collect()))
    assert {r.mnemonic for r in spark.read.format("stdf").option("types", "PIR,PRR").load(str(folder)).filter("error IS NULL").collect()} == {"PIR", "PRR"}


def test_commands(spark, folder, tmp_path, capsys):
    a = str(folder / "a.stdf")
    assert main(["dump", a, "--limit", "3"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines == ["FAR CPU_TYPE=2 STDF_VER=4", "MIR LOT_ID=LOT2 PART_TYP=T JOB_NAM=J START_T=2", "PIR HEAD_NUM=1 SITE_NUM=2"]
    assert main(["dump", a, "--limit", "0"], spark) == 0 and capsys.readouterr().out == ""
    assert main(["check", a], spark) == 0
    out = capsys.readouterr().out
    assert out.startswith("FILE file:") and "bin 2 appears in PRRs" in out and "SUMMARY 0 fatal  0 error  2 warning  0 info  0 decode_error" in out
    assert main(["batch-check", str(folder)], spark) == 1
    assert "1 decode_error" in capsys.readouterr().out
    assert main(["info", str(folder)], spark) == 0 and "little" in capsys.readouterr().out
    assert main(["convert", a, str(tmp_path / "eav")], spark) == 0 and main(["dashboard", str(tmp_path / "eav"), str(tmp_path / "d.html")], spark) == 0
    assert main(["convert-partitioned", a, "--output", str(tmp_path / "set")], spark) == 0 and main(["verify-dataset", str(tmp_path / "set")], spark) == 0
    assert main(["recover-dataset", str(tmp_path / "set")], spark) == 0 and main(["dashboard-dir", str(tmp_path / "set"), str(tmp_path / "e.html")], spark) == 0
    assert main(["convert-many", a, "--output", str(tmp_path / "many")], spark) == 0 and main(["to-ascii", a, str(tmp_path / "ascii")], spark) == 0
    assert (tmp_path / "d.html").exists() and (tmp_path / "e.html").exists()
    text = next((tmp_path / "ascii").rglob("*.txt")).read_text()
    assert text.startswith("FAR\n  CPU_TYPE:") and "  RESULT:       4.000000000 V" in text and "  START_T:      01-Jan-1970 00:00:02" in text


def test_blocks(spark):
    rows = [("f", 1, "PTR", '{"test_num": 7, "test_flg": 2, "result": 1.5, "res_scal": 3, "units": "V"}'), ("f", 2, "TSR", '{"test_num": 7, "test_min": 0.5}'), ("f", 3, "RDR", '{"num_bins": 1}'), ("f", 4, "XXX", None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, None) for r in rows], "source_id string, offset bigint, mnemonic string, fields string, rec_typ int, rec_sub int, rec_len int, error string")
    out = {r.offset: r.block for r in render.ascii_blocks(df).collect()}
    assert "RESULT" not in out[1] and "  TEST_MIN:     500.000000000 mV" in out[2] and out[3] == "RDR" and out[4] == "UNKNOWN 1,2"
    assert render.script_json({"a": "</script>&", "b": float("nan"), "c": 1.23456789}) == '{"a": "\\u003c/script\\u003e\\u0026", "b": null, "c": 1.234568}'
    with pytest.raises(ValueError):
        render.page("t", {"a": {}}, 10)


def test_arrivals(spark, folder, tmp_path):
    catalog = storage.Catalog(spark, str(tmp_path / "set"))
    (tmp_path / "set").mkdir()

    def once():
        ingest.ingest(ingest.arrivals(spark, str(folder)), catalog, str(tmp_path / "point")).awaitTermination()
        return catalog.load()

    first = once()
    assert first["run"]["status"] == "complete" and len(first["sources"]) == 1 and catalog.rows().count() == 5
    assert spark.read.parquet(str(tmp_path / "set" / "_errors")).count() == 1
    assert once()["revision"] == first["revision"]
    (folder / "c.stdf").write_bytes(decoded.file_bytes(3, EVENTS))
    assert len(once()["sources"]) == 2 and catalog.rows().count() == 10


def test_tailed_parts(spark, tmp_path):
    shape = "source_id string, head_num int, site_num int, offset bigint, mnemonic string"
    batches = [[("PTR", 1), ("PIR", 2), ("PTR", 3)], [("PTR", 4), ("PRR", 5), ("PTR", 6)], [("PRR", 7), ("PRR", 8)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for i, batch in enumerate(batches):
        spark.createDataFrame([("a", 1, 0, o, m) for m, o in batch], shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = ingest.tailed_attempts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, i
    out = sorted((r.offset, r.prr_offset, r.part_number) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(3, 5, 2), (4, 5, 2), (6, 7, 3)]
