"""Conformance rules as queries over record streams.

A stream has source_id, offset, mnemonic, head_num, site_num (the site group of WIR and WRR) and, where a
rule needs them, lot_id, test_num, test_txt, opt_flag, lo_limit, hi_limit, bin and count. Windows run
per source and position, so a file's order is explicit and no group is larger than a file. Each rule
returns source_id, severity, rule, record_type, offset, message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import limits_valid

# Severities, rule names and the texts of findings.
SEVERITIES = ("fatal", "error", "warning", "info")
NO_MRR = "No MRR found; writer likely aborted and bin/lot summary may be incomplete."
OPEN_WIR = "%s WIR(s) unclosed by WRR; aborted mid-wafer"
OPEN_PIR = "PIR for head=%s site=%s never closed by PRR; aborted during part test"
OPEN_BPS = "%s BPS section(s) not closed by EPS"
LIMIT_ORDER = "test %s lo_limit %s > hi_limit %s"
NO_LOT = "MIR.LOT_ID is empty"
OTHER_NAME = "test_num %s has name %s here (prev %s at %s)"
BIN_DIFFERS = "bin %s HBR says %s but PRR count is %s"
BIN_WITHOUT_HBR = "bin %s appears in PRRs (%s times) but has no HBR record"
PIR_OPEN = "PIR at %s for head=%s site=%s opened while previous PIR at %s for the same site never closed"
PRR_ALONE = "PRR at %s for head=%s site=%s has no matching PIR"
PIR_LEFT = "PIR at %s for head=%s site=%s never closed; file likely truncated mid-part"
WIR_OPEN = "WIR at %s for head=%s site_grp=%s opened while previous WIR at %s for the same head/site_grp never closed"
WRR_ALONE = "WRR at %s for head=%s site_grp=%s has no matching WIR"
WIR_LEFT = "WIR at %s for head=%s site_grp=%s never closed by WRR"
EPS_ALONE = "EPS without matching BPS"
BPS_LEFT = "%s BPS record(s) never closed by EPS"
SECOND_MIR = "MIR seen %s times; spec requires exactly one"

FINDING = "source_id string, severity string, rule string, record_type string, offset bigint, message string"


def _say(text: str, *values: Column) -> Column:
    """A text with its %s filled in."""
    parts = text.split("%s")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(rest)]
    return F.concat(*out)


def _hex(offset: Column) -> Column:
    return F.format_string("0x%08x", offset)


def _found(df: DataFrame, severity: str, rule: str, record: str | Column | None, message: Column, offset: Column | None = None) -> DataFrame:
    kind = record if isinstance(record, Column) else F.lit(record).cast("string")
    at = F.col("offset") if offset is None else offset
    return df.select("source_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), kind.alias("record_type"), at.cast("bigint").alias("offset"), message.alias("message"))


def _no_offset() -> Column:
    return F.lit(None).cast("bigint")


def _pairs(stream: DataFrame, begin: str, end: str, rule: str, texts: tuple[str, str, str]) -> DataFrame:
    """Begins while open, ends without a begin, and begins still open at the end of the file."""
    order = Window.partitionBy("source_id", "head_num", "site_num").orderBy("offset")
    kind, at, head, site = F.col("mnemonic"), _hex(F.col("offset")), F.col("head_num"), F.col("site_num")
    rows = stream.filter(kind.isin(begin, end)).withColumn("before", F.lag(F.struct(kind.alias("kind"), "offset")).over(order))
    rows = rows.withColumn("after", F.lead(kind).over(order))
    twice = (kind == begin) & (F.col("before.kind") == begin)
    alone = (kind == end) & (F.coalesce("before.kind", F.lit(end)) == end)
    message = F.when(twice, _say(texts[0], at, head, site, _hex(F.col("before.offset")))).when(alone, _say(texts[1], at, head, site))
    bad = _found(rows.withColumn("said", message).filter("said IS NOT NULL"), "error", rule, kind, F.col("said"))
    left = rows.filter((kind == begin) & F.col("after").isNull())
    return bad.unionByName(_found(left, "error", rule, begin, _say(texts[2], at, head, site)))


def pir_prr_pairs(stream: DataFrame) -> DataFrame:
    """V1."""
    return _pairs(stream, "PIR", "PRR", "STRUCT/PIR_PRR_PAIR", (PIR_OPEN, PRR_ALONE, PIR_LEFT))


def wir_wrr_pairs(stream: DataFrame) -> DataFrame:
    """V2; a WIR without a site group has group 255."""
    grouped = stream.withColumn("site_num", F.coalesce("site_num", F.lit(255)))
    return _pairs(grouped, "WIR", "WRR", "STRUCT/WIR_WRR_PAIR", (WIR_OPEN, WRR_ALONE, WIR_LEFT))


def _depths(stream: DataFrame, begin: str, end: str) -> DataFrame:
    """The begins and ends of each file with the depth after each; ends at depth 0 (under) leave it there."""
    order = Window.partitionBy("source_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = stream.filter(F.col("mnemonic").isin(begin, end))
    rows = rows.withColumn("sum", F.sum(F.when(F.col("mnemonic") == begin, 1).otherwise(-1)).over(order))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(order)))
    # a step below the smallest sum so far is an end at depth 0
    return rows.select("source_id", "offset", "mnemonic", (F.col("sum") - F.col("low")).alias("depth"), "low")


def bps_eps_balance(stream: DataFrame) -> DataFrame:
    """V3: the depth has its floor at 0; what is open at the end starts at the first begin after the last depth of 0."""
    rows = _depths(stream, "BPS", "EPS")
    was = F.coalesce(F.lag("low").over(Window.partitionBy("source_id").orderBy("offset")), F.lit(0))
    under = rows.withColumn("was", was).filter("low < was")
    bad = _found(under, "error", "STRUCT/BPS_EPS_BALANCE", "EPS", F.lit(EPS_ALONE))
    ends = rows.groupBy("source_id").agg(
        F.max_by("depth", "offset").alias("left"),
        F.max(F.when(F.col("depth") == 0, F.col("offset"))).alias("zero"),
        F.min("offset").alias("start"),
    )
    ends = ends.filter("left > 0").select("source_id", "left", F.coalesce("zero", F.col("start") - 1).alias("zero"))
    first = rows.join(ends, "source_id").filter("offset > zero").groupBy("source_id", "left").agg(F.min("offset").alias("offset"))
    return bad.unionByName(_found(first, "error", "STRUCT/BPS_EPS_BALANCE", "BPS", _say(BPS_LEFT, F.col("left"))))


def mir_singleton(stream: DataFrame) -> DataFrame:
    """V4."""
    order = Window.partitionBy("source_id").orderBy("offset")
    more = stream.filter(F.col("mnemonic") == "MIR").withColumn("n", F.row_number().over(order)).filter("n > 1")
    return _found(more, "error", "STRUCT/MIR_SINGLETON", "MIR", _say(SECOND_MIR, F.col("n")))


def no_mrr(stream: DataFrame) -> DataFrame:
    """V5 in part: files without an MRR."""
    ends = stream.groupBy("source_id").agg(F.count_if(F.col("mnemonic") == "MRR").alias("n"))
    return _found(ends.filter("n = 0"), "warning", "ABORT/NO_MRR", None, F.lit(NO_MRR), _no_offset())


def aborted(stream: DataFrame) -> DataFrame:
    """V5: what the end of each file leaves open: no MRR, open WIRs (at the file's last offset), PIRs, and BPS sections."""

    def left(begin: str, end: str) -> DataFrame:
        return _depths(stream, begin, end).groupBy("source_id").agg(F.max_by("depth", "offset").alias("left")).filter("left > 0")

    last = stream.groupBy("source_id").agg(F.max("offset").alias("offset"))
    wafers = _found(left("WIR", "WRR").join(last, "source_id"), "error", "ABORT/OPEN_WIR", "WIR", _say(OPEN_WIR, F.col("left")))
    kind = F.col("mnemonic")
    parts = stream.filter(kind.isin("PIR", "PRR")).groupBy("source_id", "head_num", "site_num")
    # a later PIR replaces an open one, so the last record of a position decides
    parts = parts.agg(F.max_by("mnemonic", "offset").alias("end"), F.max("offset").alias("offset")).filter("end = 'PIR'")
    parts = _found(parts, "error", "ABORT/OPEN_PIR", "PIR", _say(OPEN_PIR, F.col("head_num"), F.col("site_num")))
    sections = _found(left("BPS", "EPS"), "warning", "ABORT/OPEN_BPS", "BPS", _say(OPEN_BPS, F.col("left")), _no_offset())
    return no_mrr(stream).unionByName(wafers).unionByName(parts).unionByName(sections)


def _short(value: Column) -> Column:
    """A number without a fraction of zero."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


def limit_order(stream: DataFrame) -> DataFrame:
    """V6: PTRs with both limits valid and the low one above."""
    low, high = limits_valid(F.col("opt_flag"))
    tests = stream.filter("mnemonic = 'PTR'") if "mnemonic" in stream.columns else stream
    odd = tests.filter(low & high & (F.col("lo_limit") > F.col("hi_limit")))
    message = _say(LIMIT_ORDER, F.col("test_num"), _short(F.col("lo_limit")), _short(F.col("hi_limit")))
    return _found(odd, "error", "FIELD/PTR_LIMIT_ORDER", "PTR", message)


def result_present(stream: DataFrame) -> DataFrame:
    """V7: declared, and finds nothing: a PTR always has a result."""
    return _found(stream.limit(0), "error", "FIELD/PTR_RESULT_PRESENT", "PTR", F.lit(""))


def lot_id_present(stream: DataFrame) -> DataFrame:
    """V8."""
    empty = stream.filter((F.col("mnemonic") == "MIR") & (F.trim(F.coalesce("lot_id", F.lit(""))) == ""))
    return _found(empty, "warning", "FIELD/MIR_LOT_ID", "MIR", F.lit(NO_LOT))


def _quoted(name: Column) -> Column:
    plain = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def test_names(stream: DataFrame) -> DataFrame:
    """V9: the first name of each test is looked up by a join on its smallest offset, not by a window."""
    tests = stream.filter(F.col("mnemonic") == "PTR").select("source_id", "offset", "test_num", F.coalesce("test_txt", F.lit("")).alias("name"))
    first = tests.groupBy("source_id", "test_num").agg(F.min(F.struct("offset", "name")).alias("f"))
    odd = tests.join(first, ["source_id", "test_num"]).filter("name <> f.name")
    message = _say(OTHER_NAME, F.col("test_num"), _quoted(F.col("name")), _quoted(F.col("f.name")), _hex(F.col("f.offset")))
    return _found(odd, "warning", "SEMANTIC/TEST_NAME_CONSISTENCY", "PTR", message)


def bin_counts(summaries: DataFrame, parts: DataFrame) -> DataFrame:
    """Bins whose HBR count isn't the number of PRRs.

    summaries: source_id, head_num, site_num, hard_bin, count (HBRs; those of a position add up); parts:
    source_id, hard_bin (PRRs). Counts of single sites add up; totals (head or site 255) count, the largest, only where a bin has none of those.
    """
    each = summaries.groupBy("source_id", "head_num", "site_num", "hard_bin").agg(F.sum("count").alias("count"))
    total = (F.col("head_num") == 255) | (F.col("site_num") == 255)
    said = each.groupBy("source_id", "hard_bin").agg(
        F.coalesce(F.sum(F.when(~total, F.col("count"))), F.max(F.when(total, F.col("count")))).cast("bigint").alias("said")
    )
    met = parts.groupBy("source_id", "hard_bin").agg(F.count("*").alias("met"))
    both = said.join(met, ["source_id", "hard_bin"], "full_outer").filter(F.col("said").isNull() | (F.col("said") != F.coalesce("met", F.lit(0))))
    bin_, seen = F.col("hard_bin"), F.coalesce("met", F.lit(0))
    message = F.when(F.col("said").isNull(), _say(BIN_WITHOUT_HBR, bin_, seen)).otherwise(_say(BIN_DIFFERS, bin_, F.col("said"), seen))
    return _found(both, "warning", "SEMANTIC/HBR_BIN_COUNT", "HBR", message, _no_offset())


def _bins(stream: DataFrame) -> DataFrame:
    """V10 over a stream with the columns bin and count."""
    said = stream.filter("mnemonic = 'HBR'").select("source_id", "head_num", "site_num", F.col("bin").alias("hard_bin"), "count")
    return bin_counts(said, stream.filter("mnemonic = 'PRR'").select("source_id", F.col("bin").alias("hard_bin")))


#: The rules of a full check; callers may pass other lists of functions of a stream to check().
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "STRUCT/PIR_PRR_PAIR": pir_prr_pairs,
    "STRUCT/WIR_WRR_PAIR": wir_wrr_pairs,
    "STRUCT/BPS_EPS_BALANCE": bps_eps_balance,
    "STRUCT/MIR_SINGLETON": mir_singleton,
    "ABORT": aborted,
    "FIELD/PTR_LIMIT_ORDER": limit_order,
    "FIELD/PTR_RESULT_PRESENT": result_present,
    "FIELD/MIR_LOT_ID": lot_id_present,
    "SEMANTIC/TEST_NAME_CONSISTENCY": test_names,
    "SEMANTIC/HBR_BIN_COUNT": _bins,
}


def check(stream: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The findings of all rules; rows of the stream without a mnemonic (decode errors) take no part."""
    stream = stream.filter("mnemonic IS NOT NULL")
    found = None
    for rule in (RULES if rules is None else rules).values():
        found = rule(stream) if found is None else found.unionByName(rule(stream))
    return found


def ordered(findings: DataFrame) -> DataFrame:
    """By file and offset, those without an offset last."""
    return findings.orderBy("source_id", F.asc_nulls_last("offset"), "rule", "message")


def report(findings: DataFrame, sources: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """For each file, its findings by severity, its decode errors, and what follows from them.

    sources: source_id of all files, so that clean ones have a row; errors: source_id of each decode error.
    """
    per = findings.groupBy("source_id").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.bool_or(F.col("rule").startswith("ABORT")).alias("likely_aborted")
    )
    whole = (findings if sources is None else sources).select("source_id").distinct()
    cut = (findings.limit(0) if errors is None else errors).groupBy("source_id").agg(F.count("*").alias("decode_error"))
    out = whole.join(per, "source_id", "left").join(cut, "source_id", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in (*SEVERITIES, "decode_error")}
    return out.select(
        "source_id", *(v.alias(c) for c, v in n.items()),
        (sum(n.values(), F.lit(0)) == 0).alias("is_clean"), (n["fatal"] + n["error"] + n["decode_error"] > 0).alias("has_errors"),
        F.coalesce("likely_aborted", F.lit(False)).alias("likely_aborted"),
    )


def attempts(stream: DataFrame) -> DataFrame:
    """X1, X2 in relational form: each test with its attempt's number and the offset of its PRR.

    A record opens an attempt if it is a PIR, or if none or a PRR came before it at its position. The window's
    rows carry all that is needed, so nothing is joined: an attempt's last record is its PRR, if it has one.
    """
    place = ["source_id", "head_num", "site_num"]
    order = Window.partitionBy(*place).orderBy("offset")
    rows = stream.filter(F.col("mnemonic").isin("PIR", "PTR", "PRR"))
    opens = (F.col("mnemonic") == "PIR") | (F.coalesce(F.lag("mnemonic").over(order), F.lit("PRR")) == "PRR")
    rows = rows.withColumn("opens", opens).withColumn("attempt", F.sum(F.col("opens").cast("int")).over(order))
    started = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("source_id").orderBy("offset"))
    rows = rows.withColumn("started", started)
    whole = Window.partitionBy(*place, "attempt")
    rows = rows.withColumn("prr_offset", F.min(F.when(F.col("mnemonic") == "PRR", F.col("offset"))).over(whole))
    rows = rows.withColumn("part_sequence", F.min(F.when(F.col("opens"), F.col("started"))).over(whole).cast("int"))
    return rows.filter("mnemonic = 'PTR' AND prr_offset IS NOT NULL").select(*place, "offset", "prr_offset", "part_sequence")
