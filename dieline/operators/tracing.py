"""Test-flow evidence of devices: cells of attempts, and the dense matrix of statuses.

Attempts have device, step (null if no flow step matches), obs_ord (their chronology), passed, hard_bin
and soft_bin (null where unknown). Flows are small tables: step, position, required, stop_on_fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(attempts: DataFrame) -> DataFrame:
    """One row per device and step; partial aggregation only, so a device may have any number of attempts."""
    known = attempts.filter("step IS NOT NULL").groupBy("device", "step")

    def differs(col: str):
        return F.coalesce(F.min(col) != F.max(col), F.lit(False))

    out = known.agg(
        F.count("*").alias("tests"),
        differs("passed").alias("verdict_changed"),
        differs("hard_bin").alias("hard_bin_changed"),
        differs("soft_bin").alias("soft_bin_changed"),
        F.bool_or(F.col("passed").isNull() | F.col("hard_bin").isNull() | F.col("soft_bin").isNull()).alias("incomplete"),
        F.max(F.struct("obs_ord", "passed"))["passed"].alias("latest_passed"),
    )
    changed = F.col("verdict_changed") | F.col("hard_bin_changed") | F.col("soft_bin_changed")
    status = F.when(changed, "retest_different").when(F.col("incomplete"), "indeterminate")
    status = status.when(F.col("tests") > 1, "retest_consistent").otherwise("tested")
    return out.withColumn("retests", F.col("tests") - 1).withColumn("status", status)


def matrix(cells_: DataFrame, flow: DataFrame, closed: DataFrame) -> DataFrame:
    """Every device with every step of the flow.

    The flow is a configuration of a few steps, so each device is exploded by an array of them.
    closed has the devices that will not be tested further.
    """
    steps = [tuple(r) for r in flow.select("step", "position", "required", "stop_on_fail").collect()]
    array = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(p).alias("position"), F.lit(r).alias("required"), F.lit(x).alias("stop")) for s, p, r, x in steps))
    devices = cells_.select("device").distinct().join(closed.select("device").distinct().withColumn("closed", F.lit(True)), "device", "left")
    dense = devices.select("device", F.coalesce("closed", F.lit(False)).alias("closed"), F.explode(array).alias("s")).select("device", "closed", "s.*")
    dense = dense.join(cells_.select("device", "step", "tests", "status", "incomplete", "latest_passed"), ["device", "step"], "left")
    tested = F.col("tests").isNotNull()
    unclear = F.col("latest_passed").isNull() | F.col("incomplete")
    dense = dense.withColumn("stops", F.col("stop") & tested & ~F.coalesce(unclear, F.lit(True)) & ~F.coalesce("latest_passed", F.lit(True)))
    dense = dense.withColumn("doubts", F.col("stop") & tested & unclear)
    before = Window.partitionBy("device").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("device")
    stopped, doubted = (F.coalesce(F.bool_or(c).over(before), F.lit(False)) for c in ("stops", "doubts"))
    last = F.coalesce(F.max(F.when(tested, F.col("position"))).over(whole), F.lit(-1))
    empty = (
        F.when(~F.col("required"), "not_applicable").when(stopped, "not_applicable").when(doubted, "indeterminate")
        .when(F.col("closed") | (F.col("position") < last), "missing").otherwise("pending")
    )
    return dense.withColumn("empty", empty).select("device", "step", F.when(tested, F.col("status")).otherwise(F.col("empty")).alias("status"))
