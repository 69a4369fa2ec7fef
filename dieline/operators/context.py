"""What holds where a part opens: the wafer, as of the opening's offset.

A stream has source_id, offset, mnemonic, head_num, site_num (of a WIR or WRR its site group, null for all
sites), site_grp (of an SDR, one row for each of its sites) and wafer_id. Each look-up back in time is a window over
the events and the openings of one key, sorted by offset: a file's events are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_of(openings: DataFrame, events: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    """openings with the latest earlier event's value of the same keys, null if there is none."""
    columns = [*openings.columns, name]
    a = openings.withColumn(name, F.lit(None).cast(events.select(what.alias("v")).schema["v"].dataType)).withColumn("opens", F.lit(True))
    b = events.select(*keys, "offset", what.alias(name), F.lit(False).alias("opens"))
    order = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn(name, F.last(name, ignorenulls=True).over(order))
    return rows.filter("opens").select(columns)


def wafers(stream: DataFrame) -> DataFrame:
    """source_id, offset, head_num, site_num and wafer_id of each PIR.

    An SDR puts sites into groups; a WIR sets the wafer of its group, 255 if it names none, and a WRR ends it. A part has the
    wafer of its site's group, else that of group 255, else the only one on its head; several are ambiguous.
    """
    openings = stream.filter("mnemonic = 'PIR'").select("source_id", "offset", "head_num", "site_num")
    groups = stream.filter("mnemonic = 'SDR'").select("source_id", "offset", "head_num", "site_num", "site_grp")
    events = stream.filter("mnemonic IN ('WIR', 'WRR')").select(
        "source_id", "offset", "head_num", F.coalesce("site_num", F.lit(255)).alias("grp"), (F.col("mnemonic") == "WIR").alias("on"), "wafer_id"
    )
    state = F.struct("on", "wafer_id")
    found = _as_of(openings, groups, ["source_id", "head_num", "site_num"], F.col("site_grp"), "grp")
    found = _as_of(found, events, ["source_id", "head_num", "grp"], state, "own")
    found = _as_of(found.withColumn("group", F.col("grp")).withColumn("grp", F.lit(255)), events, ["source_id", "head_num", "grp"], state, "all")

    # how many groups of a head have a wafer, and the sum of the offsets at which these began: of one, that is its offset
    before = Window.partitionBy("source_id", "head_num", "grp").orderBy("offset")
    was = F.coalesce(F.lag(F.when(F.col("on"), F.col("offset"))).over(before), F.lit(-1))
    steps = events.withColumn("was", was)
    more = F.col("on").cast("bigint") - (F.col("was") >= 0).cast("bigint")
    moved = F.when(F.col("on"), F.col("offset")).otherwise(0) - F.greatest("was", F.lit(0))
    running = Window.partitionBy("source_id", "head_num").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("n", F.sum(more).over(running)).withColumn("since", F.sum(moved).over(running))
    found = _as_of(found, steps, ["source_id", "head_num"], F.struct("n", "since"), "head")
    begun = events.filter("on").select("source_id", "head_num", F.col("offset").alias("since"), F.col("wafer_id").alias("only"))
    found = found.withColumn("since", F.when(F.col("head.n") == 1, F.col("head.since"))).join(begun, ["source_id", "head_num", "since"], "left")
    wafer = (
        F.when(F.col("group").isNotNull() & F.coalesce("own.on", F.lit(False)), F.col("own.wafer_id"))
        .when(F.coalesce("all.on", F.lit(False)), F.col("all.wafer_id")).otherwise(F.col("only"))
    )
    return found.select("source_id", "offset", "head_num", "site_num", wafer.alias("wafer_id"))
