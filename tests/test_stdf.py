import gzip
import random
import struct

from dieline.operators import analytics as A
from dieline.sources import records as R
from dieline.sources import stdf


def cn(s):
    return bytes([len(s)]) + s.encode()


FAR = R.frame(0, 10, b"\x02\x04")


def mir(lot):
    return R.frame(1, 10, struct.pack("<IIBBBBHB", 0, 0, 1, 32, 32, 32, 0, 32) + cn(lot) + cn("") * 4)


def wir(wafer, group=255):
    return R.frame(2, 10, struct.pack("<BBI", 1, group, 0) + cn(wafer))


def pir(site):
    return R.frame(5, 10, bytes([1, site]))


def ptr(num, site, value, flag=0, text=None, low=None, high=None):
    body = struct.pack("<IBBBBf", num, 1, site, flag, 0, value)
    if text is not None:
        body += cn(text) + cn("")
    if low is not None:
        body += b"\x00\x00\x00\x00" + struct.pack("<ff", low, high) + cn("V")
    return R.frame(15, 10, body)


def prr(site, flag=0, x=None, y=None, hard=1, soft=1, part=None):
    body = struct.pack("<BBBHHH", 1, site, flag, 1, hard, soft)
    if x is not None:
        body += struct.pack("<hh", x, y)
        if part is not None:
            body += struct.pack("<I", 2) + cn(part)
    return R.frame(5, 20, body)


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_records_and_errors(spark):
    data = FAR + pir(0) + ptr(1001, 0, 3.25) + prr(0) + R.frame(99, 77, b"ABC") + R.frame(15, 10, b"\x01")
    found = stdf.read_records(files(spark, a=data, b=gzip.compress(data), c=FAR + b"\x0a\x00\x0f\x0a\x01\x02", d=b"junk")).collect()
    assert [x.mnemonic for x in found if x.source_id == "a"] == ["FAR", "PIR", "PTR", "PRR", "UNKNOWN", "PTR"]
    assert [x.fields is None for x in found if x.source_id == "a"] == [False, False, False, False, True, True]
    assert [x.mnemonic for x in found if x.source_id == "b"] == ["FAR", "PIR", "PTR", "PRR", "UNKNOWN", "PTR"]
    assert [(x.mnemonic, x.error is None) for x in found if x.source_id == "c"] == [("FAR", True), (None, False)]
    assert len([x for x in found if x.source_id == "d"]) == 1


def test_big_endian_and_optional_fields():
    assert R.byte_order(b"\x00\x02\x00\x0a\x01\x04") == ">"
    name, f = R.parse(15, 10, struct.pack(">IBBBBf", 7, 1, 2, 0, 0, 1.5) + cn("t"), ">")
    assert name == "PTR" and (f["test_num"], f["result"], f["test_txt"], f["lo_limit"]) == (7, 1.5, "t", None)
    name, f = R.parse(50, 10, struct.pack("<H", 3) + b"\x00" + b"\x02\x05\x00" + b"\x0a" + cn("x"), "<")
    assert f["gen_data"] == [None, 5, "x"]


def test_any_bytes_end(spark):
    r = random.Random(1)
    seed = FAR + mir("L") + wir("W1") + pir(0) + ptr(1, 0, 1.0, text="a", low=0, high=2) + prr(0, x=1, y=2, part="P")
    odd = {}
    for i in range(150):
        data = bytearray(seed)
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(len(data))] = r.randrange(256)
        odd[f"f{i}"] = bytes(data[: r.randrange(len(data))])
    assert stdf.read_records(files(spark, **odd)).count() >= 150


def test_assembly(spark):
    data = FAR + mir("L1") + wir("W1") + pir(0) + pir(1) + ptr(10, 0, 1.0) + ptr(10, 1, 2.0) + mir("L2") + wir("W2") + prr(1, x=1, y=2) + prr(0, flag=8)
    data += ptr(11, 0, 5.0, flag=0x80) + prr(0, hard=9) + prr(1) + pir(1) + ptr(12, 1, 1.0)
    rows = stdf.read_eav(files(spark, a=data)).orderBy("prr_offset").collect()
    assert [(x.site_num, x.lot_id, x.wafer_id, x.part_sequence, x.part_pass) for x in rows] == [
        (1, "L1", "W1", 2, True), (0, "L1", "W1", 1, False), (0, "L2", "W2", 3, True)]
    assert rows[0].part_merge_key == '["wafer-prr","W1",1,2]' and rows[2].part_id == "H1_S0_P3" and rows[2].test_pass is False


def test_measured_coordinates(spark):
    data = FAR + mir('L"1')
    for x, y, extra in ((11, 21, []), (12, 20, [ptr(3, 0, 100.0, text="Vmax")]), (13, 22, [ptr(3, 0, 14.0, text="Die_X")])):
        data += pir(0) + ptr(1, 0, float(x), text="dieX") + ptr(2, 0, float(y), text="Y_INDEX") + b"".join(extra) + prr(0, x=0, y=1)
    keys = {x.part_sequence: x.part_merge_key for x in stdf.read_eav(files(spark, a=data)).collect()}
    assert keys == {1: '["lot-ptr","L\\"1",11,21]', 2: '["lot-ptr","L\\"1",12,20]', 3: None}


def test_dashboard_values(spark):
    data = FAR + mir("LOT1") + wir("W1")
    for k, (site, flag) in enumerate([(0, 0), (1, 8), (1, 0)], 1):
        data += pir(site) + ptr(100, site, float(k), text="a", low=0, high=10) + ptr(200, site, 2.0 * k, 0x80 if k == 2 else 0, text="b", low=0, high=10)
        data += prr(site, flag, x=k, y=k + 1, part=f"P{k}")
    rows = stdf.read_eav(files(spark, a=data))
    k = A.kpis(rows).first()
    assert (k["rows"], k.parts, k.failed_parts, round(k.yield_percent, 2)) == (6, 3, 1, 66.67)
    top = A.pareto(rows).first()
    assert (top.test_num, top.fail) == (200, 1)
    (c,) = A.correlations(rows).collect()
    assert c.correlation > 0.99 and c.pairs == 3
