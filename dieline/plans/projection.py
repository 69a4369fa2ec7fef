"""The driver's events as EAV rows and as test attempts, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E

EAV_SQL = """
    SELECT event_id AS obs_ord,
           concat('LOT', cast(user_id % 5 AS string)) AS lot_id,
           CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN 'w-bad' ELSE concat('W', cast(user_id % 7 AS string)) END AS wafer_id,
           CASE WHEN user_id % 23 = 0 THEN '' ELSE concat('P', cast(user_id % 50 AS string)) END AS part_id,
           1 AS head_num,
           cast(user_id % 4 AS int) AS site_num,
           cast(user_id % 13 - 1 AS int) AS x_coord,
           CASE WHEN user_id % 29 = 0 THEN NULL ELSE cast(user_id % 11 AS int) END AS y_coord,
           CASE WHEN user_id % 6 = 0 THEN 9 ELSE 1 END AS hard_bin,
           CASE WHEN user_id % 6 = 0 THEN 99 ELSE 1 END AS soft_bin,
           user_id % 6 <> 0 AS part_pass,
           cast(CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 200 WHEN 'purchase' THEN 300 WHEN 'signup' THEN 400 ELSE 500 END AS bigint) AS test_num,
           CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS test_txt,
           'PTR' AS test_type,
           CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 211 = 0 THEN cast('NaN' AS float) ELSE cast(value AS float) END AS result,
           CASE WHEN event_id % 19 = 0 THEN NULL ELSE value <= 100 END AS test_pass,
           CASE WHEN event_type = 'view' THEN NULL ELSE cast(0.5 AS float) END AS lo_limit,
           cast(90.0 AS float) AS hi_limit,
           'V' AS units,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 500 END AS test_time_ms,
           user_id AS part_sequence
    FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAV rows with their merge key and scoped part key."""
    rows = spark.sql(EAV_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    key = E.wafer_key(F.col("wafer_id"), F.col("x_coord"), F.col("y_coord"))
    rows = rows.withColumn("part_merge_key", key)
    return rows.withColumn("part_key", E.scoped_part_key(F.col("part_merge_key"), F.lit(""), F.col("part_sequence")))


#: The same columns for DuckDB, as a common table expression.
EAV_CTE = f"""
    base AS ({EAV_SQL.replace("AS string)", "AS varchar)")}),
    keyed AS (
        SELECT *, CASE WHEN regexp_full_match(wafer_id, '[A-Z0-9]+') AND x_coord > 0 AND y_coord > 0
                       THEN concat('["wafer-prr","', wafer_id, '",', x_coord, ',', y_coord, ']') END AS part_merge_key
        FROM base
    ),
    eav AS (
        SELECT *, coalesce(part_merge_key, concat('["unresolved","",', part_sequence, ']')) AS part_key,
               CASE WHEN coalesce(test_txt, '') = '' THEN concat('TEST ', test_num) ELSE concat(test_num, ' - ', test_txt) END AS label_text,
               coalesce(NOT test_pass, false) OR coalesce(NOT isnan(result) AND result < lo_limit, false)
                   OR coalesce(NOT isnan(result) AND result > hi_limit, false) AS failed,
               coalesce(isfinite(result), false) AND (coalesce(result < lo_limit, false) OR coalesce(result > hi_limit, false)) AS limit_failed,
               CASE WHEN isfinite(result) THEN cast(result AS double) END AS number
        FROM keyed
    )
"""


#: Events as a record stream: users are sites, and three sources share them.
STREAM_SQL = """
    SELECT concat('f', cast(user_id % 3 AS string)) AS source_id, event_id AS offset, 1 AS head_num, cast(user_id % 7 AS int) AS site_num,
           CASE event_type WHEN 'click' THEN 'PIR' WHEN 'signup' THEN 'PRR' WHEN 'error' THEN 'MIR' ELSE 'PTR' END AS mnemonic,
           CASE event_type WHEN 'view' THEN 1 ELSE 2 END AS test_num, CASE WHEN event_id % 41 = 0 THEN 'odd' ELSE event_type END AS test_txt
    FROM events
"""

#: Events as wafers, sections and runs in a record stream; some runs have no lot.
SECTION_SQL = """
    SELECT concat('g', cast(user_id % 11 AS string)) AS source_id, event_id AS offset, 1 AS head_num, CASE WHEN user_id % 3 = 0 THEN NULL ELSE cast(user_id % 3 AS int) END AS site_num,
           CASE event_type WHEN 'click' THEN 'WIR' WHEN 'signup' THEN 'WRR' WHEN 'view' THEN 'BPS' WHEN 'purchase' THEN 'EPS' ELSE CASE WHEN user_id % 22 = 5 THEN 'MRR' ELSE 'MIR' END END AS mnemonic,
           CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN NULL ELSE 'LOT' END AS lot_id
    FROM events
"""

#: Events as test attempts of devices.
ATTEMPT_SQL = """
    SELECT user_id AS device, event_id AS obs_ord,
           CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'O' END AS step,
           CASE WHEN event_id % 97 = 0 THEN NULL ELSE value <= 100 END AS passed,
           CASE WHEN event_id % 89 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 1 ELSE event_id % 2 END AS hard_bin,
           1 AS soft_bin
    FROM events
"""


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def duck(sql: str) -> str:
    return sql.replace("AS string)", "AS varchar)")
