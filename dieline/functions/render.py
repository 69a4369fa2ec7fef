"""Records as text: lines, blocks, scaled values, and self-contained HTML pages (SC3-SC9, SC16, SC17, K8-K11).

Lines and blocks are column expressions over records whose fields are JSON, so they need no Python on executors.
"""

from __future__ import annotations

import json
import math
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import PREFIXES, epoch_text

# The fields of each one-line layout; a final PASSED is derived.
LINES = {
    "FAR": "CPU_TYPE STDF_VER",
    "MIR": "LOT_ID PART_TYP JOB_NAM START_T",
    "MRR": "FINISH_T DISP_COD",
    "PCR": "HEAD_NUM SITE_NUM PART_CNT RTST_CNT ABRT_CNT GOOD_CNT FUNC_CNT",
    "HBR": "HEAD_NUM SITE_NUM HBIN_NUM HBIN_CNT HBIN_NAM",
    "SBR": "HEAD_NUM SITE_NUM SBIN_NUM SBIN_CNT SBIN_NAM",
    "PMR": "PMR_INDX CHAN_NAM PHY_NAM LOG_NAM",
    "WIR": "HEAD_NUM SITE_GRP START_T WAFER_ID",
    "WRR": "HEAD_NUM SITE_GRP FINISH_T PART_CNT WAFER_ID",
    "PIR": "HEAD_NUM SITE_NUM",
    "PRR": "HEAD_NUM SITE_NUM NUM_TEST HARD_BIN SOFT_BIN PART_ID PASSED",
    "TSR": "HEAD_NUM SITE_NUM TEST_NUM EXEC_CNT FAIL_CNT TEST_NAM",
    "PTR": "TEST_NUM HEAD_NUM SITE_NUM RESULT TEST_TXT PASSED",
    "MPR": "TEST_NUM HEAD_NUM SITE_NUM RTN_ICNT RSLT_CNT TEST_TXT",
    "FTR": "TEST_NUM HEAD_NUM SITE_NUM TEST_TXT PASSED",
    "GDR": "FLD_CNT GEN_DATA",
    "DTR": "TEXT_DAT",
}


def _field(name: str) -> Column:
    return F.get_json_object("fields", f"$.{name.lower()}")


def _passed(kind: str) -> Column:
    if kind == "PRR":
        return (_field("PART_FLG").cast("int").bitwiseAND(0x18) == 0).cast("string")
    flag = _field("TEST_FLG").cast("int")
    return F.when(flag.bitwiseAND(0x40) != 0, "None").otherwise((flag.bitwiseAND(0x80) == 0).cast("string"))


def text_line() -> Column:
    """SC16: one line per record: its name and NAME=value of its layout; a missing value is empty, a type without a layout shows all fields."""
    out = F.when(
        F.col("fields").isNull(),
        F.concat(F.lit("UNKNOWN REC_TYP="), F.col("rec_typ").cast("string"), F.lit(" REC_SUB="), F.col("rec_sub").cast("string"), F.lit(" LEN="), F.col("rec_len").cast("string")),
    )
    for kind, names in LINES.items():
        parts = [F.lit(kind)]
        for n in names.split():
            value = _passed(kind) if n == "PASSED" else F.coalesce(_field(n), F.lit(""))
            parts.append(F.concat(F.lit(f"{n}="), value))
        out = out.when(F.col("mnemonic") == kind, F.concat_ws(" ", *parts))
    return out.otherwise(F.concat_ws(" ", "mnemonic", "fields"))


def dump(records: DataFrame, limit: int | None = None) -> DataFrame:
    """P10: the lines of a file's records in order; a limit of 0 gives none."""
    out = records.filter("error IS NULL").select("source_id", "offset", text_line().alias("line")).orderBy("source_id", "offset")
    return out if limit is None else out.limit(limit)


def scaled(value: Column, scale: Column) -> Column:
    """SC7: value times ten to the scale, by division where the scale is negative."""
    size = F.pow(F.lit(10.0), F.abs(F.coalesce(scale, F.lit(0)).cast("double")))
    return F.when(F.coalesce(scale, F.lit(0)) >= 0, value.cast("double") * size).otherwise(value.cast("double") / size)


def si_prefix(scale: Column) -> Column:
    """SC8: the prefix of a unit by its scale."""
    found = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    return F.coalesce(found[F.coalesce(scale, F.lit(0)).cast("int")], F.lit(""))


def fixed(value: Column, digits: int = 9) -> Column:
    """SC9: a number with so many decimals."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def json_number(value: Column) -> Column:
    """SC9: rounded to six decimals, null if it isn't finite."""
    wide = value.cast("double")
    return F.when(~F.isnan(wide) & (F.abs(wide) < float("inf")), F.round(wide, 6))


def hex_list(values: Column) -> Column:
    """SC4: an array of small numbers as hexadecimal pairs."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), " ")


#: Record types that a block names only, and fields that hold times.
_NAME_ONLY = ("PGR", "PLR", "RDR", "WCR")
_TIMES = ("setup_t", "start_t", "finish_t", "mod_tim")


def first_scales(records: DataFrame) -> DataFrame:
    """The scale and units of the first PTR or MPR of each test of a file."""
    rows = records.filter(F.col("mnemonic").isin("PTR", "MPR") & F.col("fields").isNotNull())
    each = F.struct("offset", _field("RES_SCAL").cast("int").alias("scale"), _field("UNITS").alias("units"))
    return rows.groupBy("source_id", _field("TEST_NUM").cast("bigint").alias("test_num")).agg(F.min(each).alias("f")).select("source_id", "test_num", "f.scale", "f.units")


def ascii_blocks(records: DataFrame) -> DataFrame:
    """SC17, K10: each record as a block of lines: its name, and its fields in order, padded to 15.

    Times are dates, results of PTRs are scaled and hidden where the flag says that they aren't valid; values of
    TSRs are scaled like the first PTR or MPR of their test. Returns source_id, offset, block.
    """
    shape = "map<string,string>"
    rows = records.filter("error IS NULL").withColumn("all", F.from_json("fields", shape)).withColumn("test_num", _field("TEST_NUM").cast("bigint"))
    rows = rows.join(first_scales(records), ["source_id", "test_num"], "left")
    own = F.coalesce(_field("RES_SCAL").cast("int"), F.when(F.col("mnemonic") == "TSR", F.col("scale")), F.lit(0))
    rows = rows.withColumn("own", own).withColumn("unit", F.coalesce(_field("UNITS"), "units", F.lit("")))
    hidden = (F.col("mnemonic") == "PTR") & (F.coalesce(_field("TEST_FLG").cast("int"), F.lit(0)).bitwiseAND(2) != 0)
    values = ("result", "lo_limit", "hi_limit", "test_min", "test_max")

    def shown(k: Column, v: Column) -> Column:
        time = F.when(v == "0", v).otherwise(epoch_text(v.try_cast("bigint")))
        number = F.concat(fixed(scaled(v.try_cast("double"), F.col("own"))), F.lit(" "), si_prefix(F.col("own")), F.col("unit"))
        return F.when(k.isin(*_TIMES), time).when(k.isin(*values), number).otherwise(v)

    lines = F.transform(
        F.filter(F.map_entries("all"), lambda e: ~((e["key"] == "result") & hidden)),
        lambda e: F.concat(F.rpad(F.concat(F.lit("  "), F.upper(e["key"]), F.lit(":")), 15, " "), F.lit(" "), F.coalesce(shown(e["key"], e["value"]), F.lit(""))),
    )
    name = F.when(F.col("fields").isNull(), F.concat(F.lit("UNKNOWN "), F.col("rec_typ").cast("string"), F.lit(","), F.col("rec_sub").cast("string"))).otherwise(F.col("mnemonic"))
    body = F.when(F.col("fields").isNull() | F.col("mnemonic").isin(*_NAME_ONLY), F.array().cast("array<string>")).otherwise(lines)
    return rows.select("source_id", "offset", F.array_join(F.concat(F.array(name), body), "\n").alias("block"))


def write_ascii(records: DataFrame, path: str) -> None:
    """One text file per source, blocks in order; a source is sorted by one task, as its file is one."""
    blocks = ascii_blocks(records).repartition("source_id").sortWithinPartitions("source_id", "offset")
    blocks.select("source_id", "block").write.mode("errorifexists").partitionBy("source_id").text(path)


def check_text(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """FILE, finding and SUMMARY lines of a check over files, in order."""
    head = reports.select("source_id", F.lit(0).alias("k"), F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit("FILE "), "source_id").alias("line"))
    where = F.coalesce(F.format_string("0x%08x", F.col("offset")), F.lit("-"))
    said = findings.select(
        "source_id", F.lit(1).alias("k"), F.coalesce("offset", F.lit((1 << 62))).alias("at"), F.concat_ws(" ", F.upper("severity"), "rule", where, "message").alias("line")
    )
    counts = F.concat_ws("  ", *(F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in ("fatal", "error", "warning", "info", "decode_error")))
    tail = reports.select("source_id", F.lit(2).alias("k"), F.lit(0).cast("bigint").alias("at"), F.concat(F.lit("SUMMARY "), counts).alias("line"))
    return head.unionByName(said).unionByName(tail).orderBy("source_id", "k", "at", "line").select("source_id", "line")


# ---- pages


def script_json(value: object) -> str:
    """SC3: JSON that may stand inside a script element; numbers have six decimals, those that aren't finite are null."""

    def plain(x):
        if isinstance(x, float):
            return round(x, 6) if math.isfinite(x) else None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    text = json.dumps(plain(value), ensure_ascii=False, sort_keys=True)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def page(title: str, payload: dict, max_bytes: int = 32 << 20) -> str:
    """A self-contained page that shows tables of a payload {name: rows}, with a filter over them and JSON export; it loads nothing.

    A page of more than max_bytes is refused, never cut.
    """
    text = f"""<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px;text-align:left}}</style></head>
<body><h1>{escape(title)}</h1><select id="scope"></select> <input id="find" placeholder="filter"> <button id="save">JSON</button><div id="all"></div>
<script type="application/json" id="data">{script_json(payload)}</script>
<script>
const data = JSON.parse(document.getElementById('data').textContent), scope = document.getElementById('scope'), find = document.getElementById('find');
for (const k of Object.keys(data)) scope.add(new Option(k));
function show() {{
  const all = document.getElementById('all'); all.replaceChildren();
  for (const [name, rows] of Object.entries(data[scope.value] || {{}})) {{
    const kept = rows.filter(r => JSON.stringify(r).toLowerCase().includes(find.value.toLowerCase()));
    const t = document.createElement('table'), h = document.createElement('h2'); h.textContent = name + ' (' + kept.length + ')';
    if (kept.length) {{ const tr = t.insertRow(); for (const c of Object.keys(kept[0])) tr.insertCell().outerHTML = '<th>' + c + '</th>'; }}
    for (const r of kept) {{ const tr = t.insertRow(); for (const v of Object.values(r)) tr.insertCell().textContent = typeof v === 'object' ? JSON.stringify(v) : v; }}
    all.append(h, t);
  }}
}}
scope.onchange = find.oninput = show; show();
document.getElementById('save').onclick = () => {{ const a = document.createElement('a'); a.href = URL.createObjectURL(new Blob([JSON.stringify(data)])); a.download = 'data.json'; a.click(); }};
</script></body></html>"""
    if len(text.encode()) > max_bytes:
        raise ValueError(f"the page has {len(text.encode())} bytes; the limit is {max_bytes}")
    return text
