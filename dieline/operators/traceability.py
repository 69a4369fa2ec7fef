"""Evidence of devices over test flows: cells in time order, statuses of all steps, issues.

Attempts have source, run, sequence, original_identity, lot, passed, hard_bin and soft_bin (null where
unknown); runs have run, program (a map), start and finish (null where unknown). Everything is one shuffle
by device and then windows within (device, step), which Spark sorts and spills; no device is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flows import Flow


def resolved(attempts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Each attempt's identity through the aliases (original_identity, alias), and its device key."""
    if aliases is None:
        out = attempts.withColumn("identity", F.col("original_identity"))
    else:
        out = attempts.join(aliases, "original_identity", "left").withColumn("identity", F.coalesce("alias", "original_identity")).drop("alias")
    own = F.concat(F.lit("unresolved:"), F.col("source"), F.lit(":"), F.col("sequence").cast("string"))
    return out.withColumn("device", F.coalesce("identity", own))


def placed(attempts: DataFrame, runs: DataFrame, flow: Flow) -> DataFrame:
    """Attempts with their run's times and step (null if no step, or more than one, matches)."""
    steps = runs.select("run", flow.step_of(F.col("program")).alias("step"), "start", "finish")
    return attempts.join(steps, "run", "left")


def chronological(attempts: DataFrame) -> DataFrame:
    """Order (struct, by which a cell's attempts are in time) and clash, for each attempt with a step.

    A source's own sequence always holds, so sources are merged by the running maximum of their runs' starts,
    unknown starts first. clash marks what makes the order of a cell of several sources unknown: a run with
    unknown or reversed times, or one that starts no later than an earlier run of another source ends. For that,
    two running maxima suffice: the latest end so far with its source, and the latest that some other
    source displaced or did not reach; the second never belongs to the source of the first.
    """
    cell = ["device", "step"]
    own = Window.partitionBy(*cell, "source").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.filter("step IS NOT NULL")
    rows = rows.withColumn("order", F.struct(F.coalesce(F.max("start").over(own), F.lit(-1)).alias("at"), "source", "sequence"))
    earlier = Window.partitionBy(*cell).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.struct("finish", "source")
    rows = rows.withColumn("best", F.max(F.when(F.col("finish").isNotNull(), mine)).over(earlier))
    lesser = F.when(F.col("finish").isNotNull() & (F.col("best.source") != F.col("source")), F.least("best", mine))
    rows = rows.withColumn("next", F.max(lesser).over(earlier))
    other = F.when(F.col("best.source") != F.col("source"), F.col("best.finish")).otherwise(F.col("next.finish"))
    unknown = F.col("start").isNull() | F.col("finish").isNull() | (F.col("start") > F.col("finish"))
    clash = unknown | F.coalesce(other >= F.col("start"), F.lit(False))
    return rows.withColumn("clash", clash).drop("best", "next")


def cells(attempts: DataFrame) -> DataFrame:
    """One row per device and step, over the rows of chronological()."""

    def differs(col: str) -> Column:
        return F.coalesce(F.min(col) != F.max(col), F.lit(False))

    unknown = (F.min("source") != F.max("source")) & F.bool_or("clash")
    out = attempts.groupBy("device", "step").agg(
        F.count("*").alias("tests"),
        differs("passed").alias("verdict_changed"),
        differs("hard_bin").alias("hard_bin_changed"),
        differs("soft_bin").alias("soft_bin_changed"),
        F.bool_or(F.col("passed").isNull() | F.col("hard_bin").isNull() | F.col("soft_bin").isNull()).alias("incomplete"),
        unknown.alias("order_unknown"),
        F.when(~unknown, F.max(F.struct("order", "passed"))["passed"]).alias("latest_passed"),
    )
    changed = F.col("verdict_changed") | F.col("hard_bin_changed") | F.col("soft_bin_changed")
    status = F.when(changed, "retest_different").when(F.col("incomplete"), "indeterminate")
    status = status.when(F.col("tests") > 1, "retest_consistent").otherwise("tested")
    return out.withColumn("retests", F.col("tests") - 1).withColumn("status", status)


def devices(attempts: DataFrame, lots: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One row per device: identity, its lots in order, closed, and what makes it unreliable.

    lots (lot) and keys (device) are closed; each is looked up by its own semi join instead of one join with OR.
    """
    closed = F.lit(False)
    if lots is not None:
        attempts = attempts.join(lots.select("lot", F.lit(True).alias("lot_closed")).distinct(), "lot", "left")
        closed = closed | F.coalesce(F.bool_or("lot_closed"), F.lit(False))
    out = attempts.groupBy("device").agg(
        F.min("identity").alias("identity"), F.sort_array(F.collect_set("lot")).alias("lots"), closed.alias("closed"),
        F.bool_or(F.col("step").isNull()).alias("unidentified"),
    )
    if keys is not None:
        out = out.join(keys.select("device", F.lit(True).alias("key_closed")).distinct(), "device", "left")
        out = out.withColumn("closed", F.col("closed") | F.coalesce("key_closed", F.lit(False))).drop("key_closed")
    unresolved, fallback = F.col("identity").isNull(), F.coalesce(F.col("identity").startswith('["lot-ptr"'), F.lit(False))
    return out.withColumn("unresolved", unresolved).withColumn("fallback", fallback).withColumn("unreliable", unresolved | fallback | F.col("unidentified"))


def matrix(devices_: DataFrame, cells_: DataFrame, flow: Flow) -> DataFrame:
    """Every device with every step; a device is exploded by the flow's few steps."""
    dense = devices_.select("device", "closed", "unreliable", F.explode(flow.array()).alias("s")).select("device", "closed", "unreliable", "s.*")
    dense = dense.join(cells_, ["device", "step"], "left")
    tested = F.col("tests").isNotNull()
    doubt = F.col("latest_passed").isNull() | F.col("incomplete")
    dense = dense.withColumn("doubts", F.col("stop") & tested & doubt)
    dense = dense.withColumn("stops", F.col("stop") & tested & ~F.coalesce("latest_passed", F.lit(True)) & ~F.coalesce("incomplete", F.lit(True)) & ~F.col("unreliable"))
    before = Window.partitionBy("device").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    stopped, doubted = (F.coalesce(F.bool_or(c).over(before), F.lit(False)) for c in ("stops", "doubts"))
    last = F.coalesce(F.max(F.when(tested, F.col("step"))).over(Window.partitionBy("device")), F.lit(-1))
    dense = dense.withColumn("stopped", stopped).withColumn("doubted", doubted).withColumn("last", last)
    empty = (
        F.when(~F.col("required"), "not_applicable").when(F.col("unreliable"), "indeterminate").when(F.col("stopped"), "not_applicable")
        .when(F.col("doubted"), "indeterminate").when(F.col("closed") | (F.col("last") > F.col("step")), "missing").otherwise("pending")
    )
    none = F.lit(False)
    flags = ("verdict_changed", "hard_bin_changed", "soft_bin_changed", "incomplete", "order_unknown")
    return dense.select(
        "device", "step", "step_id", F.when(tested, F.col("status")).otherwise(empty).alias("status"), F.coalesce("tests", F.lit(0)).alias("tests"),
        F.coalesce("retests", F.lit(0)).alias("retests"), *(F.coalesce(c, none).alias(c) for c in flags), "latest_passed",
    )


def issues(devices_: DataFrame, matrix_: DataFrame) -> DataFrame:
    """The issues of each device, distinct and in order."""
    per = matrix_.groupBy("device").agg(
        F.bool_or(F.col("verdict_changed") | F.col("hard_bin_changed") | F.col("soft_bin_changed")).alias("changed"),
        F.bool_or(F.col("status") == "missing").alias("missing"),
        F.bool_or("incomplete").alias("incomplete"), F.bool_or("order_unknown").alias("order_unknown"),
    )
    both = devices_.join(per, "device")
    marks = {
        "identity_unresolved": "unresolved", "fallback_unlinked": "fallback", "step_unidentified": "unidentified", "retest_different": "changed",
        "missing": "missing", "result_incomplete": "incomplete", "order_unknown": "order_unknown",
    }
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.col(c), F.lit(name)) for name, c in marks.items()))))
    return both.select("device", "identity", "lots", "closed", found.alias("issues"))


def totals(issues_: DataFrame, matrix_: DataFrame) -> DataFrame:
    """The counters at the head of a report."""
    a = issues_.agg(
        F.count("*").alias("devices"), F.count_if(F.array_contains("issues", "retest_different")).alias("changed"),
        F.count_if(F.array_contains("issues", "missing")).alias("missing"),
    )
    b = matrix_.agg(F.coalesce(F.sum("tests"), F.lit(0)).cast("bigint").alias("tests"), F.coalesce(F.sum("retests"), F.lit(0)).cast("bigint").alias("retests"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").drop("one")


def filtered(issues_: DataFrame, matrix_: DataFrame, text: str = "", issue: str | None = None, step: str | None = None, x: int | None = None, y: int | None = None) -> DataFrame:
    """Devices by a part of their key or lots, an issue, a step that was tested, and coordinates; O13: by key."""
    out = issues_
    if text:
        low = text.lower()
        out = out.filter(F.lower("device").contains(low) | F.exists("lots", lambda v: F.lower(v).contains(low)))
    if issue:
        out = out.filter(F.array_contains("issues", issue))
    if step:
        out = out.join(matrix_.filter((F.col("step_id") == step) & (F.col("tests") > 0)).select("device").distinct(), "device", "left_semi")
    for at, value in ((2, x), (3, y)):
        if value is not None:
            out = out.filter(F.regexp_extract("identity", r",(\d+),(\d+)\]\z", at - 1) == str(value))
    return out.orderBy("device")


def evidence(issues_: DataFrame, matrix_: DataFrame, attempts: DataFrame, max_attempts: int = 10_000) -> DataFrame:
    """One JSON document per device with its steps and attempts, the latter by (start, source, sequence).

    A document is one value, so a device with more than max_attempts attempts is refused instead of cut.
    """
    most = attempts.groupBy("device").count().agg(F.max("count")).first()[0] or 0
    if most > max_attempts:
        raise ValueError(f"a device has {most} attempts; the limit is {max_attempts}")
    each = F.struct(F.coalesce("start", F.lit(-1)).alias("at"), "source", "sequence", "run", "step", "passed", "hard_bin", "soft_bin", "lot")
    tests = attempts.groupBy("device").agg(F.sort_array(F.collect_list(each)).alias("attempts"))
    steps = matrix_.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("step", *(c for c in matrix_.columns if c not in ("device", "step"))))).alias("steps"))
    whole = issues_.join(steps, "device", "left").join(tests, "device", "left")
    return whole.select("device", F.to_json(F.struct("*")).alias("evidence")).orderBy("device")


def trace(attempts: DataFrame, runs: DataFrame, flow: Flow, aliases: DataFrame | None = None, lots: DataFrame | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues by device and the matrix of steps, from attempts and runs."""
    rows = placed(resolved(attempts, aliases), runs, flow)
    table = devices(rows, lots, keys)
    dense = matrix(table, cells(chronological(rows)), flow)
    return issues(table, dense), dense
