"""Events written as STDF bytes, and queries that decode them again; SQL says what must come back."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import render
from ..sources import stdf
from ..sources.records import frame
from .projection import table

#: A user's events are a file, four to a part; some files are cut off after their last part, some are big-endian, some gzip.
_PARTS = """
    SELECT concat('u', cast(user_id AS string)) AS source_id, user_id, event_id, event_type, value, cast((n - 1) DIV 4 AS int) AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events})
"""
#: Names of tests by event type: two name an axis outright, one by a letter only.
NAMES = {"click": "DIE_X", "view": "Y_COORD", "purchase": "posx", "signup": "leakage", "error": "VDD"}
_NUMBERS = {"click": 100, "view": 200, "purchase": 300, "signup": 400, "error": 500}


def _text(x: str) -> bytes:
    return bytes([len(x.encode())]) + x.encode()


def file_bytes(user: int, events: list[tuple[int, int, str, float]]) -> bytes:
    """The file of a user's events (part, event id, type, value)."""
    order = ">" if user % 5 == 0 else "<"

    def record(typ: int, sub: int, code: str, *values, tail: bytes = b"") -> bytes:
        return frame(typ, sub, struct.pack(order + code, *values) + tail, order)

    lot = "" if user % 13 == 0 else f"LOT{user % 5}"
    out = [record(0, 10, "BB", 1 if order == ">" else 2, 4)]
    out.append(record(1, 10, "IIBBBBHB", 0, user, 1, 80, 32, 32, 0, 32, tail=b"".join(map(_text, (lot, "T", "N", "S", "J")))))
    if user % 3 == 0:
        out.append(record(2, 10, "BBI", 1, 255, 0, tail=_text(f"W{user % 7}" if user % 2 else "w-bad")))
    parts: dict[int, list] = {}
    for part, *rest in events:
        parts.setdefault(part, []).append(rest)
    for part, tests in sorted(parts.items()):
        out.append(record(5, 10, "BB", 1, user % 4))
        for event, kind, value in tests:
            result = float(event % 7) if event % 3 else value
            flag = 0x40 if event % 19 == 0 else 0x80 if value > 100 else 0
            limits = struct.pack(order + "Bbbbff", 0, 0, 0, 0, 0.5, 90.0)
            out.append(record(15, 10, "IBBBBf", _NUMBERS[kind], 1, user % 4, flag, 0, result, tail=_text(NAMES[kind]) + _text("") + limits + _text("V")))
        first = tests[0][0]
        out.append(record(5, 20, "BBBHHHhhI", 1, user % 4, 8 if user % 6 == 0 else 0, len(tests), first % 9, 1, first % 13 - 1, first % 11, first % 500, tail=_text(f"P{part}")))
    if user % 4:
        out.append(record(1, 20, "I", 1))
    else:
        out.append(record(5, 10, "BB", 1, user % 4)[:-1])  # cut off
    return b"".join(out)


def files(spark, sf_dir: str) -> DataFrame:
    """Path and content of each user's file."""
    events = spark.sql(_PARTS, events=table(spark, sf_dir, "events"))

    def encode(key, rows):
        import gzip

        rows = rows.sort_by("event_id")
        user = rows["user_id"][0].as_py()
        data = file_bytes(user, list(zip(*(rows[c].to_pylist() for c in ("part", "event_id", "event_type", "value")), strict=True)))
        data = gzip.compress(data) if user % 7 == 0 else data
        return pa.table([pa.array([key[0].as_py()]), pa.array([data], pa.binary())], names=["path", "content"])

    return events.groupBy("source_id").applyInArrow(encode, "path string, content binary")


def f5_summary(spark, sf_dir):
    """Records of each type and file."""
    return stdf.summary(stdf.read_records(files(spark, sf_dir)))


def f5_info(spark, sf_dir):
    """Byte order, records, and whether a file is cut off."""
    found = stdf.info(stdf.read_records(files(spark, sf_dir)))
    return found.select("source_id", "records", "byte_order", "truncated", (F.col("error").isNotNull()).alias("failed"))


def x7_eav(spark, sf_dir):
    """The rows of the decoded tests, those before a cut as well."""
    rows = stdf.read_eav(files(spark, sf_dir))
    return rows.select(
        "source_id", "lot_id", "wafer_id", "part_id", "site_num", "x_coord", "y_coord", "hard_bin", "part_pass", "test_num", "test_txt",
        F.round(F.col("result").cast("double"), 3).alias("result"), "test_pass", "test_time_ms", "part_sequence", F.round(F.col("hi_limit").cast("double"), 3).alias("hi_limit"),
    )


def i5_identity(spark, sf_dir):
    """The keys of all parts."""
    rows = stdf.read_eav(files(spark, sf_dir))
    return rows.groupBy("source_id", "part_sequence", "part_merge_key", "part_key").agg(F.count("*").alias("tests"))


def i3_axes(spark, sf_dir):
    """I3 over the distinct names."""
    names = spark.createDataFrame([(n,) for n in (*NAMES.values(), "xy", "dieX", "Die Y pos", "X_Y", "max", "Proxy y", "")], "name string")
    spot = E.axis(F.col("name"))
    return names.select("name", spot["axis"].alias("axis"), spot["rank"].alias("rank"))


def sc16_lines(spark, sf_dir):
    """SC16, P10: the lines of records without measured values."""
    lines = stdf.read_records(files(spark, sf_dir)).filter("mnemonic IN ('FAR', 'MIR', 'WIR', 'PIR', 'PRR', 'MRR')")
    return lines.select("source_id", render.text_line().alias("line")).groupBy("source_id", "line").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (f5_summary, f5_info, x7_eav, i5_identity, i3_axes, sc16_lines)}


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
_NUM = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _NUMBERS.items()) + " END"
_E = f"""WITH e AS (
        SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS part FROM events
    ), p AS (
        SELECT user_id, part, min(event_id) AS f, count(*) AS n FROM e GROUP BY ALL
    ), t AS (
        SELECT concat('u', e.user_id) AS source_id, e.user_id, CASE WHEN e.user_id % 13 = 0 THEN '' ELSE concat('LOT', e.user_id % 5) END AS lot_id,
               CASE WHEN e.user_id % 3 <> 0 THEN NULL WHEN e.user_id % 2 = 1 THEN concat('W', e.user_id % 7) ELSE 'w-bad' END AS wafer_id,
               concat('P', part) AS part_id, CAST(e.user_id % 4 AS INT) AS site_num, CAST(f % 13 - 1 AS INT) AS x_coord, CAST(f % 11 AS INT) AS y_coord,
               CAST(f % 9 AS INT) AS hard_bin, e.user_id % 6 <> 0 AS part_pass, CAST({_NUM} AS BIGINT) AS test_num, {_CASE} AS test_txt,
               CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 7 AS DOUBLE) ELSE CAST(CAST(value AS FLOAT) AS DOUBLE) END AS exact,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE value <= 100 END AS test_pass, CAST(f % 500 AS BIGINT) AS test_time_ms, part + 1 AS part_sequence
        FROM e JOIN p USING (user_id, part)
    )"""
_KINDS = """, k AS (
        SELECT user_id, 'FAR' AS mnemonic, 1 AS n FROM p GROUP BY user_id UNION ALL SELECT user_id, 'MIR', 1 FROM p GROUP BY user_id
        UNION ALL SELECT user_id, 'WIR', 1 FROM p WHERE user_id % 3 = 0 GROUP BY user_id UNION ALL SELECT user_id, 'MRR', 1 FROM p WHERE user_id % 4 <> 0 GROUP BY user_id
        UNION ALL SELECT user_id, 'PIR', count(*) FROM p GROUP BY user_id UNION ALL SELECT user_id, 'PRR', count(*) FROM p GROUP BY user_id
        UNION ALL SELECT user_id, 'PTR', CAST(sum(n) AS BIGINT) FROM p GROUP BY user_id
    )"""


def oracle_sql() -> dict[str, str]:
    whole = "exact > 0 AND exact = floor(exact)"
    return {
        "f5_summary": f"{_E}{_KINDS} SELECT concat('u', user_id) AS source_id, mnemonic, CAST(n AS BIGINT) AS records FROM k",
        "f5_info": f"""{_E}{_KINDS} SELECT concat('u', user_id) AS source_id, CAST(sum(n) AS BIGINT) AS records, CASE WHEN user_id % 5 = 0 THEN 'big' ELSE 'little' END AS byte_order,
            user_id % 4 = 0 AS truncated, user_id % 4 = 0 AS failed FROM k GROUP BY user_id""",
        "x7_eav": f"""{_E} SELECT source_id, lot_id, wafer_id, part_id, site_num, x_coord, y_coord, hard_bin, part_pass, test_num, test_txt, round(exact, 3) AS result,
            test_pass, test_time_ms, part_sequence, 90.0::DOUBLE AS hi_limit FROM t""",
        "i5_identity": f"""{_E}, a AS (
                SELECT source_id, part_sequence, any_value(lot_id) AS lot_id, any_value(wafer_id) AS wafer_id, any_value(x_coord) AS x, any_value(y_coord) AS y, count(*) AS tests,
                       count_if(test_txt = 'DIE_X') AS n2, count_if(test_txt = 'posx') AS n1, count_if(test_txt = 'Y_COORD') AS ny,
                       count_if(test_txt = 'DIE_X' AND {whole}) AS v2, min(exact) FILTER (WHERE test_txt = 'DIE_X') AS l2, max(exact) FILTER (WHERE test_txt = 'DIE_X') AS h2,
                       count_if(test_txt = 'posx' AND {whole}) AS v1, min(exact) FILTER (WHERE test_txt = 'posx') AS l1, max(exact) FILTER (WHERE test_txt = 'posx') AS h1,
                       count_if(test_txt = 'Y_COORD' AND {whole}) AS vy, min(exact) FILTER (WHERE test_txt = 'Y_COORD') AS ly, max(exact) FILTER (WHERE test_txt = 'Y_COORD') AS hy
                FROM t GROUP BY ALL
            ), b AS (
                SELECT *, CASE WHEN n2 > 0 THEN CASE WHEN v2 = n2 AND l2 = h2 THEN l2 END WHEN n1 > 0 AND v1 = n1 AND l1 = h1 THEN l1 END AS px,
                       CASE WHEN ny > 0 AND vy = ny AND ly = hy THEN ly END AS py FROM a
            ), m AS (
                SELECT *, CASE WHEN regexp_full_match(wafer_id, '[A-Z0-9]+') AND x > 0 AND y > 0 THEN concat('["wafer-prr","', wafer_id, '",', x, ',', y, ']')
                               WHEN lot_id <> '' AND px IS NOT NULL AND py IS NOT NULL THEN concat('["lot-ptr","', lot_id, '",', CAST(px AS BIGINT), ',', CAST(py AS BIGINT), ']') END AS part_merge_key
                FROM b
            ) SELECT source_id, part_sequence, part_merge_key, coalesce(part_merge_key, concat('["unresolved","', source_id, '",', part_sequence, ']')) AS part_key, tests FROM m""",
        "i3_axes": """SELECT * FROM (VALUES ('DIE_X', 'x', 2), ('Y_COORD', 'y', 2), ('posx', 'x', 1), ('leakage', NULL, NULL), ('VDD', NULL, NULL), ('xy', NULL, NULL), ('dieX', 'x', 2),
            ('Die Y pos', 'y', 2), ('X_Y', NULL, NULL), ('max', 'x', 1), ('Proxy y', 'y', 2), ('', NULL, NULL)) v(name, axis, rank)""",
        "sc16_lines": f"""{_E}, l AS (
                SELECT user_id, concat('FAR CPU_TYPE=', CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END, ' STDF_VER=4') AS line FROM p GROUP BY user_id
                UNION ALL SELECT user_id, concat('MIR LOT_ID=', CASE WHEN user_id % 13 = 0 THEN '' ELSE concat('LOT', user_id % 5) END, ' PART_TYP=T JOB_NAM=J START_T=', user_id) FROM p GROUP BY user_id
                UNION ALL SELECT user_id, concat('WIR HEAD_NUM=1 SITE_GRP=255 START_T=0 WAFER_ID=', CASE WHEN user_id % 2 = 1 THEN concat('W', user_id % 7) ELSE 'w-bad' END) FROM p
                    WHERE user_id % 3 = 0 GROUP BY user_id
                UNION ALL SELECT user_id, 'MRR FINISH_T=1 DISP_COD=' FROM p WHERE user_id % 4 <> 0 GROUP BY user_id
                UNION ALL SELECT user_id, concat('PIR HEAD_NUM=1 SITE_NUM=', user_id % 4) FROM p
                UNION ALL SELECT user_id, concat('PRR HEAD_NUM=1 SITE_NUM=', user_id % 4, ' NUM_TEST=', n, ' HARD_BIN=', f % 9, ' SOFT_BIN=1 PART_ID=P', part, ' PASSED=', user_id % 6 <> 0) FROM p
            ) SELECT concat('u', user_id) AS source_id, line, count(*) AS n FROM l GROUP BY ALL""",
    }
