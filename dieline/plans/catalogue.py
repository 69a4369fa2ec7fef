"""The queries over the reference operators and their SQL twins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import render as R
from ..operators import analytics as A
from ..operators import tracing as T
from ..operators import validation as V
from ..operators.context import wafers
from ..sources.stdf import distinct_contents
from ..sources.storage import partition_value
from . import decoded, traces
from .projection import ATTEMPT_SQL, EAV_CTE, SECTION_SQL, STREAM_SQL, duck, eav, project, table

_TABLES = {
    "a1_kpis": A.kpis,
    "a3_pareto": A.pareto,
    "a4_wafer_yield": A.wafer_yield,
    "a5_site_yield": A.site_yield,
    "a6_hard_bins": A.hard_bins,
    "a7_soft_bins": A.soft_bins,
    "a8_commonality": A.commonality,
    "a9_correlations": A.correlations,
    "a10_xy_map": A.xy_map,
    "a11_process_windows": A.process_windows,
    "a12_data_quality": A.data_quality,
}


def _over_eav(operator, spark, sf_dir, **options):
    return operator(eav(spark, sf_dir), **options)


def a2_part_rollup(spark, sf_dir):
    return A.part_rollup(eav(spark, sf_dir))


def i1_merge_keys(spark, sf_dir):
    """Rows by merge key (I1) and scoped part key."""
    rows = eav(spark, sf_dir)
    return rows.groupBy("part_merge_key", "part_key").agg(F.count("*").alias("n"))


def p1_row_predicates(spark, sf_dir):
    """P1-P5 for each row."""
    rows = A.labelled(eav(spark, sf_dir))
    limits = F.col("result"), F.col("lo_limit"), F.col("hi_limit")
    return rows.select(
        "obs_ord", A.row_failed().alias("failed"), E.limit_failed(*limits).alias("limit_failed"),
        F.coalesce(E.finite(F.col("result")), F.lit(False)).alias("finite"), F.col("label_text").alias("label"),
        E.wafer_label(F.col("wafer_id")).alias("wafer"), E.site_label(F.col("head_num"), F.col("site_num")).alias("site"),
    )


def p14_row_filter(spark, sf_dir):
    rows = A.labelled(eav(spark, sf_dir)).select("obs_ord", "lot_id", "wafer_id", F.col("label_text").alias("label"))
    return A.row_filter(rows, "PURCHASE")


def p15_failures(spark, sf_dir):
    """Failing tests with at least ten failures."""
    return A.commonality(eav(spark, sf_dir)).filter("dimension = 'test' AND count >= 10")


def p16_lot_switch(spark, sf_dir):
    return A.pareto(eav(spark, sf_dir).filter(F.col("lot_id") == "LOT3"))


def _over_stream(rule, spark, sf_dir):
    return rule(project(spark, sf_dir, STREAM_SQL))


def _over_sections(rule, spark, sf_dir):
    return rule(project(spark, sf_dir, SECTION_SQL))


def v11_report(spark, sf_dir):
    """A15, V11 over the findings of four rules; the sources are those of the stream."""
    stream = project(spark, sf_dir, SECTION_SQL)
    rules = {k: V.RULES[k] for k in ("STRUCT/WIR_WRR_PAIR", "STRUCT/BPS_EPS_BALANCE", "ABORT", "FIELD/MIR_LOT_ID")}
    return V.report(V.check(stream, rules), stream)


def x3_wafers(spark, sf_dir):
    return wafers(project(spark, sf_dir, _WAFER_SQL))


def p7_flags(spark, sf_dir):
    """Flags and bins from event ids."""
    flag = (F.col("event_id") % 256).cast("int")
    low, high = E.limits_valid(F.when(F.col("event_id") % 11 != 0, flag))
    return table(spark, sf_dir, "events").select(
        "event_id", E.ptr_passed(flag).alias("ptr"), E.part_passed(flag).alias("part"), E.traced_passed(flag).alias("traced"),
        E.valid_bin((F.col("event_id") * 7 % 65536).cast("int")).alias("bin"), low.alias("low"), high.alias("high"),
    )


def p11_partition_values(spark, sf_dir):
    """P11, SC5: folder names of texts, of no text, and of names that begin with two underscores."""
    docs = table(spark, sf_dir, "documents").filter("length(text) < 60 OR text IS NULL").select("doc_id", F.substring("text", 1, 25).alias("v"))
    made = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("__"), E.upper_letters(F.col("v")))).when(F.col("doc_id") % 13 != 0, F.col("v"))
    return docs.select("doc_id", partition_value(made).alias("folder"))


def sc6_texts(spark, sf_dir):
    """SC4, SC6-SC9: times, hexadecimal lists, scaled values and prefixes."""
    rows = table(spark, sf_dir, "events")
    scale = (F.col("event_id") % 25 - 12).cast("int")
    return rows.select(
        "event_id", E.epoch_text(F.col("event_id") * 12345).alias("time"), R.hex_list(F.array(F.col("event_id") % 256, F.col("user_id") % 256)).alias("hex"),
        R.si_prefix(scale).alias("prefix"), F.round(R.scaled(F.col("value"), (F.col("event_id") % 5 - 2).cast("int")), 6).alias("scaled"),
        R.json_number(F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("value"))).alias("number"),
    )


_RULES = {
    "v1_pir_prr_pairs": V.pir_prr_pairs,
    "v4_mir_singleton": V.mir_singleton,
    "v5_no_mrr": V.no_mrr,
    "v5_aborted": V.aborted,
    "v9_test_names": V.test_names,
    "x1_attempts": V.attempts,
}
_SECTION_RULES = {
    "v2_wir_wrr_pairs": V.wir_wrr_pairs,
    "v3_bps_eps_balance": V.bps_eps_balance,
    "v5_open_sections": V.aborted,
    "v7_result_present": V.result_present,
    "v8_lot_id": V.lot_id_present,
}


#: Events as wafers of site groups, groups of sites, and openings.
_WAFER_SQL = """SELECT concat('h', cast(user_id % 13 AS string)) AS source_id, event_id AS offset, cast(user_id % 2 AS int) AS head_num,
    CASE event_type WHEN 'click' THEN 'WIR' WHEN 'signup' THEN 'WRR' WHEN 'view' THEN 'SDR' ELSE 'PIR' END AS mnemonic,
    CASE WHEN event_type IN ('click', 'signup') THEN CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(event_id % 3 AS int) END ELSE cast(user_id % 4 AS int) END AS site_num,
    CASE WHEN event_type = 'view' THEN cast(event_id % 4 AS int) END AS site_grp, CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('W', cast(event_id AS string)) END AS wafer_id
    FROM events"""


#: Events as PTRs with limits, and as HBRs and PRRs.
_LIMITS_SQL = """SELECT concat('f', cast(user_id % 3 AS string)) AS source_id, event_id AS offset, user_id % 5 AS test_num,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 16 ELSE 0 END AS opt_flag, value AS lo_limit, 50.0 AS hi_limit FROM events"""
_BINS_SQL = """SELECT concat('f', cast(user_id % 3 AS string)) AS source_id, event_type, event_id AS offset, event_id % 19 AS hard_bin, event_id % 7 AS count,
    1 AS head_num, CASE WHEN event_id % 2 = 0 THEN 255 ELSE user_id % 4 END AS site_num FROM events"""


def v6_limit_order(spark, sf_dir):
    return V.limit_order(project(spark, sf_dir, _LIMITS_SQL))


def v10_bin_counts(spark, sf_dir):
    rows = project(spark, sf_dir, _BINS_SQL)
    return V.bin_counts(rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'signup'"))


def r2_cells(spark, sf_dir):
    return T.cells(project(spark, sf_dir, ATTEMPT_SQL))


def r4_matrix(spark, sf_dir):
    flow = spark.createDataFrame([("A", 0, True, True), ("B", 1, True, False), ("C", 2, True, False), ("O", 3, False, False)], "step string, position int, required boolean, stop_on_fail boolean")
    attempts = project(spark, sf_dir, ATTEMPT_SQL)
    return T.matrix(T.cells(attempts), flow, attempts.filter("device % 2 = 0"))


def s9_distinct_contents(spark, sf_dir):
    """Documents stand for files, their ids for paths."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    files = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").cast("binary").alias("content"))
    return distinct_contents(files).select("sha256", "copies", F.col("paths")[0].alias("first_path"))


def queries() -> dict:
    found = {name: partial(_over_eav, operator) for name, operator in _TABLES.items()}
    found |= {f"a13_{n.split('_', 1)[1]}_by_lot": partial(_over_eav, f, by=("lot_id",)) for n, f in _TABLES.items()}
    found |= {name: partial(_over_stream, rule) for name, rule in _RULES.items()}
    found |= {name: partial(_over_sections, rule) for name, rule in _SECTION_RULES.items()}
    found |= decoded.queries() | traces.queries()
    own = (x3_wafers, v11_report, p7_flags, p11_partition_values, p15_failures, sc6_texts, v6_limit_order, v10_bin_counts, r2_cells, r4_matrix, s9_distinct_contents, a2_part_rollup, i1_merge_keys, p1_row_predicates, p14_row_filter, p16_lot_switch)
    return found | {f.__name__: f for f in own}


_FIRST = "arg_min({0}, obs_ord) FILTER (WHERE {0} IS NOT NULL)"
_PERCENT = "round(CASE WHEN {1} = 0 THEN 0.0 ELSE ({0}) * 100.0 / {1} END, 6)"


def _dashboard(by: str, where: str = "") -> dict[str, str]:
    """The SQL of the tables; by is empty or the grouping column with a comma."""
    col = by.rstrip(", ")
    group = f"GROUP BY {col}" if by else ""
    over = f"PARTITION BY {col}" if by else ""

    def top(order: str, n: int) -> str:
        return f"QUALIFY row_number() OVER ({over} ORDER BY {order}) <= {n}"

    parts = f"""
        parts AS (
            SELECT {by} part_key, bool_and(part_pass) AS passed, min(struct_pack(o := obs_ord, wafer_id := wafer_id, head_num := head_num,
                   site_num := site_num, hard_bin := hard_bin, soft_bin := soft_bin)) AS f
            FROM eav GROUP BY {by} part_key
        )"""
    stats = f"""
        stats AS (
            SELECT {by} test_num, arg_min(label_text, obs_ord) AS label, arg_min(test_type, obs_ord) AS test_type,
                   {_FIRST.format("units")} AS units, count(*) AS total, count_if(test_pass) AS pass, count_if(NOT test_pass) AS fail,
                   count_if(test_pass IS NULL) AS unknown, count_if(limit_failed) AS limit_fail, avg(number) AS mean,
                   stddev_samp(number) AS sigma, min(number) AS min, max(number) AS max,
                   CAST({_FIRST.format("lo_limit")} AS DOUBLE) AS lo_limit, CAST({_FIRST.format("hi_limit")} AS DOUBLE) AS hi_limit
            FROM eav {where} GROUP BY {by} test_num
        )"""
    pareto = "fail DESC, limit_fail DESC, total DESC, label, test_num"
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sigma", "min", "max", "lo_limit", "hi_limit"))

    def yields(label: str) -> str:
        return f"""WITH {EAV_CTE}, {parts} SELECT {by} {label} AS label, count(*) AS total, count_if(passed) AS pass,
            count_if(NOT passed) AS fail, {_PERCENT.format("count_if(passed)", "count(*)")} AS yield_percent
            FROM parts GROUP BY ALL"""

    labels = {
        "wafer": "coalesce({0}wafer_id, '(no wafer)')",
        "site": "concat('H', {0}head_num, ' / S', {0}site_num)",
        "hard": "concat('HBIN ', {0}hard_bin)",
        "soft": "concat('SBIN ', {0}soft_bin)",
    }
    own = {k: v.format("") for k, v in labels.items()}
    first = {k: v.format("f.") for k, v in labels.items()}
    checks = {
        "missing limits": "lo_limit IS NULL OR hi_limit IS NULL",
        "missing part_id": "part_id = ''",
        "missing result": "result IS NULL",
        "missing test_pass": "test_pass IS NULL",
        "missing test_time_ms": "test_time_ms IS NULL",
        "missing wafer_id": "wafer_id IS NULL",
        "missing x/y coordinate": "x_coord IS NULL OR y_coord IS NULL",
        "unresolved coordinate identity": "part_merge_key IS NULL",
    }
    quality = " UNION ALL ".join(
        f"SELECT {by} '{k}' AS label, count(*) AS total, count(*) - count_if({c}) AS pass, count_if({c}) AS fail, "
        f"{_PERCENT.format(f'count(*) - count_if({c})', 'count(*)')} AS yield_percent FROM eav {group}"
        for k, c in checks.items()
    )
    dims = {
        "test": "label_text", "wafer": own["wafer"], "site": own["site"], "hard_bin": own["hard"], "soft_bin": own["soft"],
        "test_site": f"concat(label_text, ' @ ', {own['site']})", "test_hard_bin": f"concat(label_text, ' @ ', {own['hard']})",
    }
    common = " UNION ALL ".join(f"SELECT {by} '{k}' AS dimension, {v} AS label FROM eav WHERE failed" for k, v in dims.items())
    same = f"AND x.{col} = y.{col}" if by else ""
    return {
        "a1_kpis": f"""WITH {EAV_CTE}, {parts}, p AS (
                SELECT {by} count(*) AS parts, count_if(passed) AS passed_parts, count(DISTINCT (f.head_num, f.site_num)) AS sites FROM parts {group}
            ), r AS (
                SELECT {by} count(*) AS rows, count(DISTINCT test_num) AS tests, count(DISTINCT lot_id) AS lots, count(DISTINCT wafer_id) AS wafers,
                       count(DISTINCT CASE WHEN NOT test_pass THEN test_num END) AS failing_tests {"" if by else ""}
                FROM eav {group}
            )
            SELECT {f"r.{col}," if by else ""} rows, parts, passed_parts, parts - passed_parts AS failed_parts,
                   {_PERCENT.format("passed_parts", "parts")} AS yield_percent, tests, lots, wafers, sites, failing_tests
            FROM r, p {f"WHERE r.{col} = p.{col}" if by else ""}""",
        "a3_pareto": f"""WITH {EAV_CTE}, {stats} SELECT {by} label, test_num, test_type, units, total, pass, fail, unknown, limit_fail, {rounded},
            {_PERCENT.format("pass", "(pass + fail)")} AS yield_percent FROM stats {top(pareto, A.TOP)}""",
        "a4_wafer_yield": yields(first["wafer"]),
        "a5_site_yield": yields(first["site"]),
        "a6_hard_bins": yields(first["hard"]),
        "a7_soft_bins": yields(first["soft"]),
        "a8_commonality": f"""WITH {EAV_CTE}, c AS (SELECT {by} dimension, label, count(*) AS count FROM ({common}) GROUP BY ALL)
            SELECT * FROM c {top("count DESC, dimension, label", A.TOP)}""",
        "a9_correlations": f"""WITH {EAV_CTE}, {stats}, chosen AS (
                SELECT {by} test_num, label, row_number() OVER ({over} ORDER BY {pareto}) AS rank FROM stats WHERE mean IS NOT NULL AND sigma > 0
                {top(pareto, A.MAX_TESTS)}
            ), v AS (
                SELECT {f"e.{col}," if by else ""} part_key, rank, label, arg_min(number, obs_ord) AS v
                FROM eav e JOIN chosen c ON c.test_num = e.test_num {f"AND c.{col} = e.{col}" if by else ""} WHERE number IS NOT NULL GROUP BY ALL
            ), s AS (
                SELECT {f"x.{col}," if by else ""} x.rank AS i, y.rank AS j, min(x.label) AS x, min(y.label) AS y, count(*) AS pairs, sum(x.v) AS sx, sum(y.v) AS sy,
                       sum(x.v * x.v) AS sxx, sum(y.v * y.v) AS syy, sum(x.v * y.v) AS sxy
                FROM v x JOIN v y ON x.part_key = y.part_key AND x.rank < y.rank {same} GROUP BY {f"x.{col}," if by else ""} x.rank, y.rank
            ), c AS (
                SELECT *, (pairs * sxx - sx * sx) * (pairs * syy - sy * sy) AS var FROM s WHERE pairs >= 3
            ), d AS (
                SELECT *, round((pairs * sxy - sx * sy) / sqrt(var), 6) AS correlation FROM c WHERE var > 0
            ) SELECT {by} x, y, correlation, pairs FROM d {top("abs(correlation) DESC, pairs DESC, i, j", A.TOP_PAIRS)}""",
        "a10_xy_map": f"""WITH {EAV_CTE} SELECT {by} x_coord AS x, y_coord AS y, count(*) AS total, count_if(failed) AS fail,
            {_PERCENT.format("count_if(NOT failed)", "count(*)")} AS yield_percent
            FROM eav WHERE x_coord IS NOT NULL AND y_coord IS NOT NULL GROUP BY ALL""",
        "a11_process_windows": f"""WITH {EAV_CTE}, {stats}, w AS (
                SELECT *, round(CASE WHEN lo_limit IS NOT NULL AND hi_limit IS NOT NULL AND sigma > 0
                                     THEN least(hi_limit - mean, mean - lo_limit) / (3 * sigma) END, 6) AS cp
                FROM stats WHERE mean IS NOT NULL AND sigma IS NOT NULL
            ) SELECT {by} label, {rounded}, limit_fail, cp FROM w {top("limit_fail DESC, cp ASC NULLS LAST, label, test_num", A.TOP)}""",
        "a12_data_quality": f"WITH {EAV_CTE} {quality}",
    }


def oracle_sql() -> dict[str, str]:
    found = _dashboard("")
    found |= {f"a13_{n.split('_', 1)[1]}_by_lot": sql for n, sql in _dashboard("lot_id,").items()}
    found["a2_part_rollup"] = f"""WITH {EAV_CTE} SELECT part_key, bool_and(part_pass) AS passed, arg_min_null(wafer_id, obs_ord) AS wafer_id,
        arg_min(head_num, obs_ord) AS head_num, arg_min(site_num, obs_ord) AS site_num, arg_min(hard_bin, obs_ord) AS hard_bin,
        arg_min(soft_bin, obs_ord) AS soft_bin FROM eav GROUP BY part_key"""
    found["i1_merge_keys"] = f"WITH {EAV_CTE} SELECT part_merge_key, part_key, count(*) AS n FROM eav GROUP BY ALL"
    found["p1_row_predicates"] = f"""WITH {EAV_CTE} SELECT obs_ord, failed, limit_failed, coalesce(isfinite(result), false) AS finite,
        label_text AS label, coalesce(wafer_id, '(no wafer)') AS wafer, concat('H', head_num, ' / S', site_num) AS site FROM eav"""
    found["p14_row_filter"] = f"WITH {EAV_CTE} SELECT obs_ord, lot_id, wafer_id, label_text AS label FROM eav WHERE contains(lower(label_text), 'purchase')"
    found["p15_failures"] = f"SELECT * FROM ({found['a8_commonality']}) WHERE dimension = 'test' AND \"count\" >= 10"
    found["p16_lot_switch"] = _dashboard("", "WHERE lot_id = 'LOT3'")["a3_pareto"]
    found |= _STREAMS | decoded.oracle_sql() | traces.oracle_sql()
    return found


_S = f"WITH s AS ({duck(STREAM_SQL)})"
_SECTIONS = f"WITH s AS ({duck(SECTION_SQL)})"


def _pairs_sql(head: str, begin: str, end: str, rule: str, site: str, texts: tuple[str, str, str]) -> str:
    """The SQL of the pair rules; texts are those of a second begin, an end alone and a begin left open."""
    at = "printf('0x%08x', \"offset\")"

    def said(text: str, *values: str) -> str:
        parts = text.split("%s")
        return "concat(" + ", ".join(x for v, r in zip((*values, None), (f"'{p}'" for p in parts), strict=False) for x in (r, v) if x) + ")"

    return head + f""", p AS (
            SELECT * REPLACE ({site} AS site_num) FROM s WHERE mnemonic IN ('{begin}', '{end}')
        ), q AS (
            SELECT *, lag(mnemonic) OVER w AS b, lag("offset") OVER w AS bo, lead(mnemonic) OVER w AS a FROM p
            WINDOW w AS (PARTITION BY source_id, head_num, site_num ORDER BY "offset")
        ), m AS (
            SELECT source_id, mnemonic AS record_type, "offset",
                   CASE WHEN mnemonic = '{begin}' AND b = '{begin}' THEN {said(texts[0], at, "head_num", "site_num", "printf('0x%08x', bo)")}
                        WHEN mnemonic = '{end}' AND coalesce(b, '{end}') = '{end}' THEN {said(texts[1], at, "head_num", "site_num")} END AS message FROM q
            UNION ALL SELECT source_id, '{begin}', "offset", {said(texts[2], at, "head_num", "site_num")} FROM q WHERE mnemonic = '{begin}' AND a IS NULL
        ) SELECT source_id, 'error' AS severity, '{rule}' AS rule, record_type, "offset", message FROM m WHERE message IS NOT NULL"""


#: Running depth of sections by a fold over each file's ordered begins and ends.
_DEPTHS = """, l AS (
        SELECT source_id, list({'m': mnemonic, 'o': "offset"} ORDER BY "offset") AS x FROM s WHERE mnemonic IN ('BPS', 'EPS') GROUP BY source_id
    ), d AS (
        SELECT source_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM l
    ), z AS (
        SELECT source_id, i, x.m AS m, x.o AS o, sum(CASE WHEN x.m = 'BPS' THEN 1 ELSE -1 END) OVER (PARTITION BY source_id ORDER BY i) AS t FROM d
    ), y AS (
        SELECT *, least(0, min(t) OVER (PARTITION BY source_id ORDER BY i)) AS low FROM z
    ), e AS (
        SELECT source_id, max_by(t - low, i) AS left_open, max(CASE WHEN t = low THEN i ELSE 0 END) AS last_zero FROM y GROUP BY source_id
    )"""
_OPEN_SQL = """SELECT source_id, 'warning' AS severity, 'ABORT/NO_MRR' AS rule, CAST(NULL AS VARCHAR) AS record_type, CAST(NULL AS BIGINT) AS "offset",
        'No MRR found; writer likely aborted and bin/lot summary may be incomplete.' AS message FROM s GROUP BY source_id HAVING count_if(mnemonic = 'MRR') = 0"""
_STREAMS = {
    "v1_pir_prr_pairs": _pairs_sql(_S, "PIR", "PRR", "STRUCT/PIR_PRR_PAIR", "site_num", (V.PIR_OPEN, V.PRR_ALONE, V.PIR_LEFT)),
    "v2_wir_wrr_pairs": _pairs_sql(_SECTIONS, "WIR", "WRR", "STRUCT/WIR_WRR_PAIR", "coalesce(site_num, 255)", (V.WIR_OPEN, V.WRR_ALONE, V.WIR_LEFT)),
    "v3_bps_eps_balance": _SECTIONS + _DEPTHS + """ SELECT source_id, 'error' AS severity, 'STRUCT/BPS_EPS_BALANCE' AS rule, 'EPS' AS record_type, o AS "offset",
            'EPS without matching BPS' AS message
        FROM (SELECT *, lag(low, 1, 0) OVER (PARTITION BY source_id ORDER BY i) AS was FROM y) WHERE low < was
        UNION ALL SELECT e.source_id, 'error', 'STRUCT/BPS_EPS_BALANCE', 'BPS', min(y.o), concat(any_value(left_open), ' BPS record(s) never closed by EPS')
        FROM e JOIN y ON y.source_id = e.source_id AND y.i > e.last_zero WHERE left_open > 0 GROUP BY e.source_id""",
    "v5_open_sections": _SECTIONS + _DEPTHS + f""", w AS (
            SELECT source_id, mnemonic, "offset" AS o, sum(CASE WHEN mnemonic = 'WIR' THEN 1 ELSE -1 END) OVER r AS t FROM s WHERE mnemonic IN ('WIR', 'WRR')
            WINDOW r AS (PARTITION BY source_id ORDER BY "offset")
        ), v AS (
            SELECT source_id, max_by(t - low, o) AS n FROM (SELECT *, least(0, min(t) OVER (PARTITION BY source_id ORDER BY o)) AS low FROM w) GROUP BY source_id
        ) {_OPEN_SQL}
        UNION ALL SELECT v.source_id, 'error', 'ABORT/OPEN_WIR', 'WIR', max(s."offset"), concat(any_value(n), ' WIR(s) unclosed by WRR; aborted mid-wafer')
        FROM v JOIN s ON s.source_id = v.source_id WHERE n > 0 GROUP BY v.source_id
        UNION ALL SELECT source_id, 'warning', 'ABORT/OPEN_BPS', 'BPS', NULL, concat(left_open, ' BPS section(s) not closed by EPS') FROM e WHERE left_open > 0""",
    "v7_result_present": """SELECT '' AS source_id, '' AS severity, '' AS rule, '' AS record_type, CAST(0 AS BIGINT) AS "offset", '' AS message WHERE false""",
    "v8_lot_id": _SECTIONS + """ SELECT source_id, 'warning' AS severity, 'FIELD/MIR_LOT_ID' AS rule, 'MIR' AS record_type, "offset", 'MIR.LOT_ID is empty' AS message
        FROM s WHERE mnemonic = 'MIR' AND trim(coalesce(lot_id, '')) = ''""",
    "v4_mir_singleton": _S + """, m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "offset") AS n FROM s WHERE mnemonic = 'MIR')
        SELECT source_id, 'error' AS severity, 'STRUCT/MIR_SINGLETON' AS rule, 'MIR' AS record_type, "offset",
               concat('MIR seen ', n, ' times; spec requires exactly one') AS message FROM m WHERE n > 1""",
    "v5_no_mrr": f"{_S} {_OPEN_SQL}",
    "v5_aborted": _S + f""", o AS (
            SELECT source_id, head_num, site_num, max("offset") AS "offset" FROM s WHERE mnemonic IN ('PIR', 'PRR') GROUP BY ALL HAVING max_by(mnemonic, "offset") = 'PIR'
        ) {_OPEN_SQL}
        UNION ALL SELECT source_id, 'error', 'ABORT/OPEN_PIR', 'PIR', "offset",
            concat('PIR for head=', head_num, ' site=', site_num, ' never closed by PRR; aborted during part test') FROM o""",
    "v6_limit_order": f"""SELECT source_id, 'error' AS severity, 'FIELD/PTR_LIMIT_ORDER' AS rule, 'PTR' AS record_type, "offset",
            concat('test ', test_num, ' lo_limit ', regexp_replace(CAST(lo_limit AS VARCHAR), '\\.0$', ''), ' > hi_limit 50') AS message
        FROM ({duck(_LIMITS_SQL).replace("AS offset", 'AS "offset"')}) WHERE opt_flag & 80 = 0 AND opt_flag & 160 = 0 AND lo_limit > hi_limit""",
    "v10_bin_counts": f"""WITH b AS ({duck(_BINS_SQL).replace("AS offset", 'AS "offset"')}), e AS (
            SELECT source_id, head_num, site_num, hard_bin, sum("count") AS n FROM b WHERE event_type = 'purchase' GROUP BY ALL
        ), h AS (
            SELECT source_id, hard_bin, CAST(coalesce(sum(n) FILTER (WHERE site_num <> 255), max(n)) AS BIGINT) AS said FROM e GROUP BY ALL
        ), p AS (
            SELECT source_id, hard_bin, count(*) AS met FROM b WHERE event_type = 'signup' GROUP BY ALL
        ) SELECT source_id, 'warning' AS severity, 'SEMANTIC/HBR_BIN_COUNT' AS rule, 'HBR' AS record_type, CAST(NULL AS BIGINT) AS "offset",
            CASE WHEN said IS NULL THEN concat('bin ', hard_bin, ' appears in PRRs (', coalesce(met, 0), ' times) but has no HBR record')
                 ELSE concat('bin ', hard_bin, ' HBR says ', said, ' but PRR count is ', coalesce(met, 0)) END AS message
        FROM h FULL JOIN p USING (source_id, hard_bin) WHERE said IS NULL OR said <> coalesce(met, 0)""",
    "v9_test_names": _S + """, t AS (
            SELECT *, first_value(test_txt) OVER w AS f, first_value("offset") OVER w AS fo FROM s WHERE mnemonic = 'PTR'
            WINDOW w AS (PARTITION BY source_id, test_num ORDER BY "offset")
        ) SELECT source_id, 'warning' AS severity, 'SEMANTIC/TEST_NAME_CONSISTENCY' AS rule, 'PTR' AS record_type, "offset",
               concat('test_num ', test_num, ' has name "', test_txt, '" here (prev "', f, '" at ', printf('0x%08x', fo), ')') AS message FROM t WHERE test_txt <> f""",
    "x1_attempts": _S + """, o AS (
            SELECT *, mnemonic = 'PIR' OR coalesce(lag(mnemonic) OVER w, 'PRR') = 'PRR' AS opens FROM s WHERE mnemonic IN ('PIR', 'PTR', 'PRR')
            WINDOW w AS (PARTITION BY source_id, head_num, site_num ORDER BY "offset")
        ), n AS (
            SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY source_id, head_num, site_num ORDER BY "offset") AS attempt,
                   sum(CAST(opens AS INT)) OVER (PARTITION BY source_id ORDER BY "offset") AS started FROM o
        ), a AS (
            SELECT source_id, head_num, site_num, attempt, min(started) FILTER (WHERE opens) AS part_sequence,
                   min("offset") FILTER (WHERE mnemonic = 'PRR') AS prr_offset FROM n GROUP BY ALL
        ) SELECT n.source_id, n.head_num, n.site_num, n."offset", a.prr_offset, CAST(a.part_sequence AS INT) AS part_sequence
        FROM n JOIN a USING (source_id, head_num, site_num, attempt) WHERE n.mnemonic = 'PTR' AND a.prr_offset IS NOT NULL""",
    "s9_distinct_contents": """SELECT sha256(text) AS sha256, count(*) AS copies, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS first_path
        FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)""",
    "x3_wafers": f"""WITH s AS ({duck(_WAFER_SQL).replace("AS offset", "AS o")}), p AS (SELECT * FROM s WHERE mnemonic = 'PIR'), g AS (
            SELECT p.source_id, p.o, p.head_num, p.site_num, arg_max(d.site_grp, d.o) AS grp
            FROM p LEFT JOIN s d ON d.mnemonic = 'SDR' AND d.source_id = p.source_id AND d.head_num = p.head_num AND d.site_num = p.site_num AND d.o < p.o GROUP BY ALL
        ), w AS (
            SELECT source_id, o, head_num, coalesce(site_num, 255) AS grp, mnemonic = 'WIR' AS active, wafer_id FROM s WHERE mnemonic IN ('WIR', 'WRR')
        ), k AS (
            SELECT g.source_id, g.o, g.head_num, g.site_num, g.grp AS mine, w.grp, max(struct_pack(o := w.o, active := w.active, wafer := w.wafer_id)) AS last
            FROM g JOIN w ON w.source_id = g.source_id AND w.head_num = g.head_num AND w.o < g.o GROUP BY ALL
        ), a AS (
            SELECT source_id, o, max(CASE WHEN grp = mine THEN 1 WHEN grp = 255 THEN 0 END) AS best, count(*) AS n,
                   arg_max(struct_pack(v := last.wafer), CASE WHEN grp = mine THEN 2 WHEN grp = 255 THEN 1 ELSE 0 END) AS top
            FROM k WHERE last.active GROUP BY source_id, o
        ) SELECT g.source_id, g.o AS "offset", g.head_num, g.site_num, CASE WHEN best IS NOT NULL OR n = 1 THEN top.v END AS wafer_id FROM g LEFT JOIN a USING (source_id, o)""",
    "p7_flags": """WITH f AS (SELECT event_id, event_id % 256 AS flag, event_id * 7 % 65536 AS bin, CASE WHEN event_id % 11 <> 0 THEN event_id % 256 END AS opt FROM events)
        SELECT event_id, CASE WHEN flag & 64 = 0 THEN flag & 128 = 0 END AS ptr, flag & 24 = 0 AS part, CASE WHEN flag & 20 = 0 THEN flag & 8 = 0 END AS traced,
               CASE WHEN bin <= 32767 THEN CAST(bin AS INT) END AS bin, coalesce(opt & 80 = 0, false) AS low, coalesce(opt & 160 = 0, false) AS high FROM f""",
    "p11_partition_values": """WITH d AS (
            SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN concat('__', upper(substring(text, 1, 25)))
                                WHEN doc_id % 13 <> 0 THEN substring(text, 1, 25) END AS v, text FROM documents WHERE length(text) < 60 OR text IS NULL
        ), e AS (
            SELECT doc_id, CASE WHEN doc_id % 11 = 0 AND doc_id % 7 <> 0 AND text IS NULL THEN NULL ELSE v END AS v FROM d
        ) SELECT doc_id, CASE WHEN v IS NULL THEN '__HIVE_DEFAULT_PARTITION__' WHEN v = '' THEN '__empty'
               ELSE regexp_replace(array_to_string(list_transform(string_split(v, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Z0-9_-]') THEN c
                    ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), ''), '^__', '%5F_') END AS folder FROM e""",
    "sc6_texts": """SELECT event_id, strftime(make_timestamp(event_id * 12345 * 1000000), '%d-%b-%Y %H:%M:%S') AS time,
               printf('%02X %02X', event_id % 256, user_id % 256) AS hex,
               CASE event_id % 25 - 12 WHEN 12 THEN 'p' WHEN 9 THEN 'n' WHEN 6 THEN 'u' WHEN 3 THEN 'm' WHEN 2 THEN '%' WHEN -3 THEN 'K' WHEN -6 THEN 'M'
                    WHEN -9 THEN 'G' WHEN -12 THEN 'T' ELSE '' END AS prefix,
               round(CASE WHEN event_id % 5 >= 2 THEN value * pow(10.0, event_id % 5 - 2) ELSE value / pow(10.0, 2 - event_id % 5) END, 6) AS scaled,
               CASE WHEN event_id % 9 <> 0 THEN round(value, 6) END AS number FROM events""",
    "v11_report": "",
}
_PARTS = {k: _STREAMS[k].split(_SECTIONS, 1)[1] for k in ("v2_wir_wrr_pairs", "v3_bps_eps_balance", "v5_open_sections", "v8_lot_id")}
_STREAMS["v11_report"] = f"""WITH f AS ({" UNION ALL ".join(f"(SELECT source_id, severity, rule FROM ({_SECTIONS}{x}))" for x in _PARTS.values())}), c AS (
        SELECT source_id, count_if(severity = 'fatal') AS fatal, count_if(severity = 'error') AS error, count_if(severity = 'warning') AS warning,
               count_if(severity = 'info') AS info, bool_or(starts_with(rule, 'ABORT')) AS likely_aborted FROM f GROUP BY source_id
    ) SELECT s.source_id, coalesce(fatal, 0) AS fatal, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info,
        CAST(0 AS BIGINT) AS decode_error, c.source_id IS NULL AS is_clean, coalesce(fatal + error, 0) > 0 AS has_errors, coalesce(likely_aborted, false) AS likely_aborted
    FROM (SELECT DISTINCT source_id FROM ({duck(SECTION_SQL)})) s LEFT JOIN c USING (source_id)"""
_CELLS = f"""WITH t AS ({duck(ATTEMPT_SQL)}), g AS (
        SELECT device, step, count(*) AS tests, count(DISTINCT passed) > 1 AS verdict_changed, count(DISTINCT hard_bin) > 1 AS hard_bin_changed,
               count(DISTINCT soft_bin) > 1 AS soft_bin_changed, bool_or(passed IS NULL OR hard_bin IS NULL OR soft_bin IS NULL) AS incomplete,
               max(struct_pack(o := obs_ord, p := passed)).p AS latest_passed
        FROM t WHERE step IS NOT NULL GROUP BY device, step
    ), c AS (
        SELECT *, tests - 1 AS retests, CASE WHEN verdict_changed OR hard_bin_changed OR soft_bin_changed THEN 'retest_different'
               WHEN incomplete THEN 'indeterminate' WHEN tests > 1 THEN 'retest_consistent' ELSE 'tested' END AS status FROM g
    )"""
_STREAMS |= {
    "r2_cells": f"{_CELLS} SELECT * FROM c",
    "r4_matrix": f"""{_CELLS}, flow AS (
            SELECT * FROM (VALUES ('A', 0, true, true), ('B', 1, true, false), ('C', 2, true, false), ('O', 3, false, false)) f(step, position, required, stop)
        ), d AS (
            SELECT v.device, v.device % 2 = 0 AS closed, f.*, c.tests, c.status, c.incomplete, c.latest_passed
            FROM (SELECT DISTINCT device FROM c) v CROSS JOIN flow f LEFT JOIN c ON c.device = v.device AND c.step = f.step
        ), e AS (
            SELECT *, max(CASE WHEN tests IS NOT NULL THEN position END) OVER (PARTITION BY device) AS last,
                   bool_or(stop AND tests IS NOT NULL AND NOT incomplete AND latest_passed = false) OVER earlier AS stopped,
                   bool_or(stop AND tests IS NOT NULL AND (incomplete OR latest_passed IS NULL)) OVER earlier AS doubted
            FROM d WINDOW earlier AS (PARTITION BY device ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ) SELECT device, step, CASE WHEN tests IS NOT NULL THEN status WHEN NOT required THEN 'not_applicable' WHEN coalesce(stopped, false) THEN 'not_applicable'
               WHEN coalesce(doubted, false) THEN 'indeterminate' WHEN closed OR position < last THEN 'missing' ELSE 'pending' END AS status FROM e""",
}
