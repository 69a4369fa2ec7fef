"""Events as attempts of devices in runs of several sources, through the traceability operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows
from ..operators import traceability as T
from .projection import project

#: One event is one attempt. Users are devices, some of them without identity, some with a fallback one of which some have an alias.
ATTEMPTS = """
    SELECT concat('s', cast(event_id % 3 AS string)) AS source, concat('s', cast(event_id % 3 AS string), ':', cast(cast(floor(event_id / 40) AS bigint) AS string), '-', event_type) AS run,
           event_id AS sequence,
           CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('["lot-ptr","L",', cast(user_id + 1 AS string), ',1]') ELSE concat('["wafer-prr","W",', cast(user_id + 1 AS string), ',1]') END AS original_identity,
           concat('LOT', cast(user_id % 9 AS string)) AS lot, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value <= 100 END AS passed,
           CASE WHEN event_id % 89 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 1 ELSE event_id % 2 END AS hard_bin, 1 AS soft_bin
    FROM events
"""
#: A run is all of a source's events of a type within forty; some of its times are unknown or overlap with another's.
RUNS = """
    SELECT run, event_type, any_start AS start, CASE WHEN any_start % 17 = 0 THEN NULL WHEN any_start % 5 = 0 THEN any_start + 90 ELSE any_start + 3 END AS finish
    FROM (SELECT run, event_type, CASE WHEN min_id % 23 = 0 THEN NULL ELSE min_id END AS any_start FROM (
        SELECT concat('s', cast(event_id % 3 AS string), ':', cast(cast(floor(event_id / 40) AS bigint) AS string), '-', event_type) AS run, event_type, min(event_id) AS min_id FROM events
        GROUP BY concat('s', cast(event_id % 3 AS string), ':', cast(cast(floor(event_id / 40) AS bigint) AS string), '-', event_type), event_type) q) r
"""
FLOW = flows.Flow.parse({"flow_id": "F", "version": "1", "steps": [
    {"id": "A", "required": True, "stop_on_fail": True, "matches": [{"job_nam": "click"}]},
    {"id": "B", "required": True, "matches": [{"job_nam": "view", "job_rev": "v"}]},
    {"id": "C", "required": True, "matches": [{"job_nam": "purchase"}, {"test_cod": "purchase"}]},
    {"id": "O", "required": False, "matches": [{"job_nam": "signup"}]},
    {"id": "Z", "required": True, "matches": [{"job_nam": "signup", "flow_id": "none"}]},
]})


def _inputs(spark, sf_dir):
    attempts, runs = project(spark, sf_dir, ATTEMPTS), project(spark, sf_dir, RUNS)
    kind = F.col("event_type")
    program = F.create_map(F.lit("job_nam"), kind, F.lit("job_rev"), F.when(kind == "view", F.lit("v")), F.lit("test_cod"), kind, F.lit("flow_id"), F.lit(None).cast("string"))
    return attempts, runs.withColumn("program", program)


def _tables(spark, sf_dir):
    attempts, runs = _inputs(spark, sf_dir)
    users = range(1, 2000, 14)
    aliases = flows.alias_table(spark, flows.parse_mappings([{"from": ["lot-ptr", "L", u + 1, 1], "to": ["wafer-prr", "W", u + 1, 1]} for u in users]))
    lots = spark.createDataFrame([("LOT3",), ("LOT5",)], "lot string")
    keys = spark.createDataFrame([(f'["wafer-prr","W",{u},1]',) for u in range(3, 2000, 10)], "device string")
    rows = T.placed(T.resolved(attempts, aliases), runs, FLOW)
    table = T.devices(rows, lots, keys)
    cells = T.cells(T.chronological(rows))
    return rows, table, cells


def r3_cells(spark, sf_dir):
    """Cells with their order."""
    return _tables(spark, sf_dir)[2].select("device", "step", "tests", "retests", "verdict_changed", "hard_bin_changed", "incomplete", "order_unknown", "latest_passed", "status")


def r4_devices(spark, sf_dir):
    """Every device with every step."""
    _, table, cells = _tables(spark, sf_dir)
    return T.matrix(table, cells, FLOW).select("device", "step", "step_id", "status", "tests", "retests")


def r6_issues(spark, sf_dir):
    """Devices with lots, closure and issues."""
    _, table, cells = _tables(spark, sf_dir)
    found = T.issues(table, T.matrix(table, cells, FLOW))
    return found.select("device", "identity", F.array_join("lots", ",").alias("lots"), "closed", F.array_join("issues", ",").alias("issues"))


def a19_totals(spark, sf_dir):
    _, table, cells = _tables(spark, sf_dir)
    dense = T.matrix(table, cells, FLOW)
    return T.totals(T.issues(table, dense), dense)


def p17_filtered(spark, sf_dir):
    """Devices of a lot with an issue that were tested in a step."""
    _, table, cells = _tables(spark, sf_dir)
    dense = T.matrix(table, cells, FLOW)
    return T.filtered(T.issues(table, dense), dense, "lot4", "retest_different", "C").select("device", F.array_join("issues", ",").alias("issues"))


def queries() -> dict:
    return {f.__name__: f for f in (r3_cells, r4_devices, r6_issues, a19_totals, p17_filtered)}


def _duck(sql: str) -> str:
    return sql.replace("AS string)", "AS varchar)")


_CELLS = f"""WITH a AS ({_duck(ATTEMPTS)}), u AS ({_duck(RUNS)}), b AS (
        SELECT a.*, u.start, u.finish, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS step,
               CASE WHEN starts_with(original_identity, '["lot-ptr"') AND (TRY_CAST(regexp_extract(original_identity, ',(\\d+),1', 1) AS INT) - 2) % 14 = 0
                    AND TRY_CAST(regexp_extract(original_identity, ',(\\d+),1', 1) AS INT) < 2000 THEN replace(replace(original_identity, 'lot-ptr', 'wafer-prr'), '"L"', '"W"')
                    ELSE original_identity END AS identity
        FROM a LEFT JOIN u USING (run)
    ), d AS (
        SELECT *, coalesce(identity, concat('unresolved:', source, ':', sequence)) AS device FROM b
    ), o AS (
        SELECT *, coalesce(max(start) OVER (PARTITION BY device, step, source ORDER BY sequence), -1) AS since FROM d WHERE step IS NOT NULL
    ), n AS (
        SELECT *, row_number() OVER (PARTITION BY device, step ORDER BY since, source, sequence) AS k FROM o
    ), clash AS (
        SELECT DISTINCT x.device, x.step FROM n x JOIN n y ON x.device = y.device AND x.step = y.step AND x.k < y.k AND x.source <> y.source AND x.finish >= y.start
    ), g AS (
        SELECT device, step, count(*) AS tests, count(*) - 1 AS retests, count(DISTINCT passed) > 1 AS verdict_changed, count(DISTINCT hard_bin) > 1 AS hard_bin_changed,
               bool_or(passed IS NULL OR hard_bin IS NULL) AS incomplete, count(DISTINCT source) > 1 AS several,
               bool_or(start IS NULL OR finish IS NULL OR start > finish) AS unknown, arg_max_null(passed, k) AS last_passed
        FROM n GROUP BY device, step
    ), c AS (
        SELECT g.*, several AND (unknown OR clash.device IS NOT NULL) AS order_unknown,
               CASE WHEN NOT (several AND (unknown OR clash.device IS NOT NULL)) THEN last_passed END AS latest_passed,
               CASE WHEN verdict_changed OR hard_bin_changed THEN 'retest_different' WHEN incomplete THEN 'indeterminate' WHEN tests > 1 THEN 'retest_consistent' ELSE 'tested' END AS status
        FROM g LEFT JOIN clash ON clash.device = g.device AND clash.step = g.step
    ), v AS (
        SELECT device, min(identity) AS identity, array_to_string(list_sort(list(DISTINCT lot)), ',') AS lots,
               bool_or(lot IN ('LOT3', 'LOT5')) OR coalesce(bool_or(starts_with(device, '["wafer-prr","W",') AND TRY_CAST(regexp_extract(device, ',(\\d+),1', 1) AS INT) % 10 = 3
                   AND TRY_CAST(regexp_extract(device, ',(\\d+),1', 1) AS INT) < 2000), false) AS closed, bool_or(step IS NULL) AS unidentified
        FROM d GROUP BY device
    ), w AS (
        SELECT *, identity IS NULL AS unresolved, coalesce(starts_with(identity, '["lot-ptr"'), false) AS fallback FROM v
    ), flow AS (
        SELECT * FROM (VALUES (0, 'A', true, true), (1, 'B', true, false), (2, 'C', true, false), (3, 'O', false, false), (4, 'Z', true, false)) f(step, step_id, required, stop)
    ), e AS (
        SELECT w.device, closed, unresolved OR fallback OR unidentified AS unreliable, flow.*, c.tests, c.retests, c.status, c.incomplete, c.order_unknown, c.verdict_changed, c.hard_bin_changed, c.latest_passed
        FROM w CROSS JOIN flow LEFT JOIN c ON c.device = w.device AND c.step = flow.step
    ), s AS (
        SELECT *, max(CASE WHEN tests IS NOT NULL THEN step END) OVER (PARTITION BY device) AS last,
               bool_or(stop AND tests IS NOT NULL AND latest_passed = false AND NOT incomplete AND NOT unreliable) OVER earlier AS stopped,
               bool_or(stop AND tests IS NOT NULL AND (latest_passed IS NULL OR incomplete)) OVER earlier AS doubted
        FROM e WINDOW earlier AS (PARTITION BY device ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), m AS (
        SELECT * REPLACE (CASE WHEN tests IS NOT NULL THEN status WHEN NOT required THEN 'not_applicable' WHEN unreliable THEN 'indeterminate' WHEN coalesce(stopped, false) THEN 'not_applicable'
               WHEN coalesce(doubted, false) THEN 'indeterminate' WHEN closed OR coalesce(last, -1) > step THEN 'missing' ELSE 'pending' END AS status) FROM s
    ), i AS (
        SELECT w.device, w.identity, w.lots, w.closed, concat_ws(',', CASE WHEN w.fallback THEN 'fallback_unlinked' END, CASE WHEN w.unresolved THEN 'identity_unresolved' END,
               CASE WHEN bool_or(m.status = 'missing') THEN 'missing' END, CASE WHEN bool_or(m.order_unknown) THEN 'order_unknown' END, CASE WHEN bool_or(m.incomplete) THEN 'result_incomplete' END,
               CASE WHEN bool_or(m.verdict_changed OR m.hard_bin_changed) THEN 'retest_different' END, CASE WHEN w.unidentified THEN 'step_unidentified' END) AS issues
        FROM w JOIN m USING (device) GROUP BY w.device, w.identity, w.lots, w.closed, w.fallback, w.unresolved, w.unidentified
    )"""


def oracle_sql() -> dict[str, str]:
    return {
        "r3_cells": f"{_CELLS} SELECT device, step, tests, retests, verdict_changed, hard_bin_changed, incomplete, order_unknown, latest_passed, status FROM c",
        "r4_devices": f"{_CELLS} SELECT device, step, step_id, status, coalesce(tests, 0) AS tests, coalesce(retests, 0) AS retests FROM m",
        "r6_issues": f"{_CELLS} SELECT device, identity, lots, closed, issues FROM i",
        "a19_totals": f"""{_CELLS} SELECT (SELECT count(*) FROM i) AS devices, (SELECT count(*) FROM i WHERE contains(issues, 'retest_different')) AS changed,
            (SELECT count(*) FROM i WHERE contains(issues, 'missing')) AS missing, (SELECT CAST(sum(tests) AS BIGINT) FROM m) AS tests, (SELECT CAST(sum(retests) AS BIGINT) FROM m) AS retests""",
        "p17_filtered": f"""{_CELLS} SELECT device, issues FROM i WHERE contains(lower(lots), 'lot4') AND contains(issues, 'retest_different')
            AND device IN (SELECT device FROM m WHERE step_id = 'C' AND tests > 0)""",
    }
