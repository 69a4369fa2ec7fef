"""EAV rows in files and in a catalog: schema, atomic folders, reuse, verification, recovery."""

import json

import pytest

from dieline import api
from dieline.plans import decoded
from dieline.sources import stdf, storage

EVENTS = [(k, u, kind, v) for u in (1, 2, 3, 7) for k, (kind, v) in enumerate([("click", 3.0), ("view", 5.0), ("signup", 120.5), ("error", 1.5), ("click", 2.0)], u * 100)]


def put(folder, user, events, name=None):
    own = [(i // 4, *e) for i, e in enumerate(events)]
    path = folder / (name or f"u{user}.STDF")
    path.write_bytes(decoded.file_bytes(user, own))
    return f"file:{path}"


def events_of(user):
    return [(k, kind, v) for k, u, kind, v in EVENTS if u == user]


@pytest.fixture
def sources(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "other.txt").write_text("no")
    return folder, [put(folder, u, events_of(u)) for u in (1, 2, 3, 7)]


def test_find(spark, sources):
    folder, paths = sources
    assert sorted(r.path for r in stdf.find(spark, str(folder), str(folder / "u1.STDF")).select("path").collect()) == sorted(paths)
    with pytest.raises(ValueError, match="limit is 3"):
        stdf.find(spark, str(folder), max_sources=3)


def test_manifest(spark, sources, tmp_path):
    folder, _ = sources
    out = str(tmp_path / "out")
    first = api.convert(spark, str(folder), out)
    assert first["rows"] == 20 and not first["reused"]
    again = api.convert(spark, str(folder), out, overwrite=False)
    assert again["reused"] and again["rows"] == 20
    rows = storage.read_eav(spark, out)
    assert rows.count() == 20 and rows.columns[: len(storage.SCHEMA.names)] == storage.SCHEMA.names
    with pytest.raises(ValueError, match="eav-v2"):
        storage.checked(rows.withColumn("lot_id", rows.head_num))
    (tmp_path / "out" / "._manifest.json.crc").unlink()
    (tmp_path / "out" / "_manifest.json").write_text(json.dumps({"schema_version": "eav-v1"}))
    with pytest.raises(ValueError, match="eav-v1"):
        api.convert(spark, str(folder), out, overwrite=False)
    empty = storage.write_eav(spark, stdf.read_eav(stdf.find(spark, str(folder))).limit(0), str(tmp_path / "none"))
    assert empty["rows"] == 0 and storage.read_eav(spark, str(tmp_path / "none")).dtypes[0] == ("lot_id", "string")


def test_failed_write_leaves_nothing(spark, sources, tmp_path):
    folder, _ = sources
    rows = stdf.read_eav(stdf.find(spark, str(folder)))
    with pytest.raises(Exception, match="lot_id is null"):
        storage.write_eav(spark, rows.withColumn("lot_id", rows.wafer_id), str(tmp_path / "bad"))
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


def test_partitioned_folders(spark, sources, tmp_path):
    folder, _ = sources
    rows = stdf.read_eav(stdf.find(spark, str(folder)))
    storage.partitioned(storage.homogeneous(rows, ["lot-id"]), str(tmp_path / "parts"), ["lot-id", "wafer-id"], rows_per_file=3)
    names = {p.parent.name for p in (tmp_path / "parts").rglob("*.parquet")}
    assert {"wafer_id_key=__HIVE_DEFAULT_PARTITION__", "wafer_id_key=W3"} <= names
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert back.count() == 20 and back.filter("lot_id_key = 'LOT1'").count() == 5
    with pytest.raises(ValueError, match="several values"):
        storage.homogeneous(rows.withColumn("source_id", rows.units), ["lot-id"])
    with pytest.raises(ValueError, match="distinct"):
        storage.partitioned(rows, str(tmp_path / "x"), ["lot-id", "lot_id"])


def test_catalog(spark, sources, tmp_path):
    folder, paths = sources
    root = str(tmp_path / "set")
    run = api.convert_partitioned(spark, [str(folder / n) for n in ("u1.STDF", "u2.STDF")], root)
    assert run["status"] == "complete" and run["completed"] == 2 and run["rows"] == 10
    catalog = storage.Catalog(spark, root)
    assert catalog.verify()["rows"] == 10 and catalog.rows().count() == 10
    before = catalog.load()["sources"]
    # the same again reuses both; other content of one replaces it
    api.convert_partitioned(spark, [str(folder / n) for n in ("u1.STDF", "u2.STDF")], root)
    assert {k: v["generation"] for k, v in catalog.load()["sources"].items()} == {k: v["generation"] for k, v in before.items()}
    put(folder, 1, events_of(1)[:2])
    api.convert_partitioned(spark, [str(folder / "u1.STDF")], root)
    assert catalog.rows().count() == 7 and catalog.verify()["sources"] == 2
    # a file that is cut off is refused in strict mode
    (folder / "bad.stdf").write_bytes((folder / "u1.STDF").read_bytes()[:-20])
    with pytest.raises(Exception):  # noqa: B017
        api.convert_partitioned(spark, [str(folder / "bad.stdf")], root)
    assert catalog.load()["run"]["status"] == "failed" and catalog.rows().count() == 7
    run = api.convert_partitioned(spark, [str(folder / n) for n in ("bad.stdf", "u3.STDF")], root, continue_on_error=True)
    assert run["status"] == "partial" and len(run["failures"]) == 1 and catalog.rows().count() == 12
    with pytest.raises(ValueError):
        catalog.guard(f"{root}/_catalog.json")
    assert catalog.guard(str(tmp_path / "page.html"))
    # a changed fragment, an abandoned run
    fragment = tmp_path / "set" / catalog.current().first().path
    whole = fragment.read_bytes()
    (fragment.parent / f".{fragment.name}.crc").unlink()
    fragment.write_bytes(whole[:-9] + bytes([whole[-9] ^ 1]) + whole[-8:])
    with pytest.raises(Exception):  # noqa: B017
        catalog.verify()
    fragment.write_bytes(whole)
    (tmp_path / "set" / ".staging-x").mkdir()
    catalog.publish(catalog.load() | {"run": {"id": "x", "status": "running"}})
    with catalog.locked(), pytest.raises(RuntimeError):
        catalog.recover()
    assert catalog.recover() == [".staging-x"] and catalog.load()["run"]["status"] == "interrupted" and catalog.verify()["rows"] == 12


def test_pages(spark, sources, tmp_path):
    folder, _ = sources
    root = str(tmp_path / "set")
    api.convert_partitioned(spark, [str(folder / n) for n in ("u1.STDF", "u2.STDF", "u3.STDF")], root)
    api.dashboard_dir(spark, root, str(tmp_path / "page.html"), "A <b> & c")
    text = (tmp_path / "page.html").read_text()
    payload = json.loads(text.split('id="data">')[1].split("</script>")[0])
    assert payload["all"]["kpis"][0]["rows"] == 15 and {"lot LOT1", "lot LOT2", "lot LOT3"} <= payload.keys() and "A &lt;b&gt; &amp; c" in text
    with pytest.raises(ValueError, match="lots"):
        api.dashboard_dir(spark, root, str(tmp_path / "page.html"), max_lots=2)
    assert (tmp_path / "page.html").read_text() == text
