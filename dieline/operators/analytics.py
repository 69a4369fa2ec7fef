"""Yield, Pareto, commonality, correlation, map, capability and quality tables over EAV rows.

Each function takes rows of the EAV schema with the columns part_key (the scoped part key) and obs_ord
(the order of arrival, unique) and optional grouping columns, by which all of it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

TOP, TOP_PAIRS, MAX_TESTS = 40, 60, 16


def _first(col: str, *, given: bool = False) -> Column:
    """The value of the first row; with given, of the first row that has one."""
    value = F.struct(F.col("obs_ord"), F.col(col))
    return F.min(F.when(F.col(col).isNotNull(), value) if given else value)[col]


def part_rollup(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """A2: one row per part: whether every row passed, and the first row's wafer, head, site and bins."""
    meta = ("wafer_id", "head_num", "site_num", "hard_bin", "soft_bin")
    first = F.min(F.struct("obs_ord", *meta))
    out = rows.groupBy(*by, "part_key").agg(F.bool_and("part_pass").alias("passed"), first.alias("f"))
    return out.select(*by, "part_key", "passed", *(F.col(f"f.{c}").alias(c) for c in meta))


def kpis(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """A1. Rows are counted by test, lot and wafer first, far fewer than rows; distinct values are counted over those."""
    parts = part_rollup(rows, by).groupBy(*by).agg(
        F.count("*").alias("parts"),
        F.count_if("passed").alias("passed_parts"),
        F.count_distinct("head_num", "site_num").alias("sites"),
    )
    mine = ["test_num", "lot_id", "wafer_id"]
    keys = [*by, *(F.col(c).alias(f"own_{c}") for c in mine)]
    some = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(~F.col("test_pass")).alias("failing"))
    whole = some.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_distinct("own_test_num").alias("tests"),
        F.count_distinct("own_lot_id").alias("lots"),
        F.count_distinct("own_wafer_id").alias("wafers"),
        F.count_distinct(F.when(F.col("failing"), F.col("own_test_num"))).alias("failing_tests"),
    )
    one = F.lit(1).alias("one")
    both = whole.join(parts, list(by)) if by else whole.select("*", one).join(parts.select("*", one), "one")
    return both.select(
        *by, "rows", "parts", "passed_parts", (F.col("parts") - F.col("passed_parts")).alias("failed_parts"),
        F.round(E.percent(F.col("passed_parts"), F.col("parts")), 6).alias("yield_percent"),
        "tests", "lots", "wafers", "sites", "failing_tests",
    )


def test_stats(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """A3: counts and statistics of each test number. Only the smallest arrival order is kept per group."""
    r = F.col("result").cast("double")
    number = F.when(E.finite(F.col("result")), r)
    out = rows.groupBy(*by, "test_num").agg(
        _first("label_text").alias("label"),
        _first("test_type").alias("test_type"),
        _first("units", given=True).alias("units"),
        F.count("*").alias("total"),
        F.count_if("test_pass").alias("pass"),
        F.count_if(~F.col("test_pass")).alias("fail"),
        F.count_if(F.col("test_pass").isNull()).alias("unknown"),
        F.count_if(E.limit_failed(F.col("result"), F.col("lo_limit"), F.col("hi_limit"))).alias("limit_fail"),
        F.avg(number).alias("mean"),
        F.when(F.count(number) > 1, F.stddev_samp(number)).alias("sigma"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        _first("lo_limit", given=True).cast("double").alias("lo_limit"),
        _first("hi_limit", given=True).cast("double").alias("hi_limit"),
    )
    return out.withColumn("yield_percent", E.percent(F.col("pass"), F.col("pass") + F.col("fail")))


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label_text", E.test_label(F.col("test_num"), F.col("test_txt")))


def _pareto_order() -> list[Column]:
    """O1, with the test number as the last tie-break."""
    return [F.desc("fail"), F.desc("limit_fail"), F.desc("total"), F.asc("label"), F.asc("test_num")]


def _top(df: DataFrame, order: list, n: int, by: tuple) -> DataFrame:
    """The first n rows, of each group if there are any. A group's limit is applied before the shuffle, too."""
    if not by:
        return df.orderBy(*order).limit(n)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("at", at).filter(F.col("at") <= n).drop("at")


def pareto(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """A3 in the order O1."""
    out = _top(test_stats(labelled(rows), by), _pareto_order(), TOP, by)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "sigma", "min", "max", "lo_limit", "hi_limit", "yield_percent")]
    return out.select(*by, "label", "test_num", "test_type", "units", "total", "pass", "fail", "unknown", "limit_fail", *rounded)


def yields(parts: DataFrame, label: Column, by: tuple = ()) -> DataFrame:
    """Parts by a label of their first row, in the order O2."""
    out = parts.groupBy(*by, label.alias("label")).agg(F.count("*").alias("total"), F.count_if("passed").alias("pass"))
    return out.select(
        *by, "label", "total", "pass", (F.col("total") - F.col("pass")).alias("fail"),
        F.round(E.percent(F.col("pass"), F.col("total")), 6).alias("yield_percent"),
    ).orderBy(*by, F.desc("fail"), F.asc("yield_percent"), F.asc("label"))


def wafer_yield(rows: DataFrame, by: tuple = ()) -> DataFrame:
    return yields(part_rollup(rows, by), E.wafer_label(F.col("wafer_id")), by)


def site_yield(rows: DataFrame, by: tuple = ()) -> DataFrame:
    return yields(part_rollup(rows, by), E.site_label(F.col("head_num"), F.col("site_num")), by)


def hard_bins(rows: DataFrame, by: tuple = ()) -> DataFrame:
    return yields(part_rollup(rows, by), E.bin_label("HBIN", F.col("hard_bin")), by)


def soft_bins(rows: DataFrame, by: tuple = ()) -> DataFrame:
    return yields(part_rollup(rows, by), E.bin_label("SBIN", F.col("soft_bin")), by)


def row_failed() -> Column:
    return E.failed(F.col("test_pass"), F.col("result"), F.col("lo_limit"), F.col("hi_limit"))


def commonality(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """Failing rows by seven dimensions, exploded before a partial count; order O5."""
    test, site = F.col("label_text"), E.site_label(F.col("head_num"), F.col("site_num"))
    hard = E.bin_label("HBIN", F.col("hard_bin"))
    keys = {
        "test": test,
        "wafer": E.wafer_label(F.col("wafer_id")),
        "site": site,
        "hard_bin": hard,
        "soft_bin": E.bin_label("SBIN", F.col("soft_bin")),
        "test_site": F.concat(test, F.lit(" @ "), site),
        "test_hard_bin": F.concat(test, F.lit(" @ "), hard),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("label")) for k, v in keys.items()))
    out = labelled(rows).filter(row_failed()).select(*by, F.explode(pairs).alias("k")).groupBy(*by, "k.dimension", "k.label")
    out = out.agg(F.count("*").alias("count"))
    return _top(out, [F.desc("count"), F.asc("dimension"), F.asc("label")], TOP, by)


def correlations(rows: DataFrame, max_tests: int = MAX_TESTS, by: tuple = ()) -> DataFrame:
    """Pearson's r of the leading tests, over the first finite value of each part and test; order O4.

    At most max_tests tests are selected, so a part has a bounded number of values and of pairs; the
    values are pivoted by part once instead of joined with themselves.
    """
    stats = test_stats(labelled(rows), by).filter("mean IS NOT NULL AND sigma > 0")
    chosen = _top(stats, _pareto_order(), max(max_tests, 2), by)
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*_pareto_order())
    chosen = chosen.withColumn("rank", F.row_number().over(order)).select(*by, "test_num", "label", "rank")
    value = F.struct("obs_ord", F.col("result").cast("double").alias("v"))
    first = rows.filter(E.finite(F.col("result"))).join(F.broadcast(chosen) if not by else chosen, [*by, "test_num"])
    first = first.groupBy(*by, "part_key", "rank", "label").agg(F.min(value)["v"].alias("v"))
    cells = first.groupBy(*by, "part_key").agg(F.collect_list(F.struct("rank", "label", "v")).alias("c"))  # max_tests at most
    pairs = cells.select(*by, "c", F.explode("c").alias("x")).select(*by, "x", F.explode("c").alias("y")).filter("x.rank < y.rank")
    x, y = F.col("x.v"), F.col("y.v")
    sums = pairs.groupBy(*by, F.col("x.rank").alias("i"), F.col("y.rank").alias("j")).agg(
        F.min("x.label").alias("x"), F.min("y.label").alias("y"), F.count("*").alias("pairs"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n = F.col("pairs")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    sums = sums.withColumn("var", var).filter("pairs >= 3 AND var > 0")
    sums = sums.withColumn("correlation", F.round((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt("var"), 6))
    order = [F.desc(F.abs("correlation")), F.desc("pairs"), F.asc("i"), F.asc("j")]
    return _top(sums, order, TOP_PAIRS, by).select(*by, "x", "y", "correlation", "pairs")


def xy_map(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """A10: rows and failing rows by coordinates, in their order."""
    placed = rows.filter("x_coord IS NOT NULL AND y_coord IS NOT NULL")
    out = placed.groupBy(*by, F.col("x_coord").alias("x"), F.col("y_coord").alias("y"))
    out = out.agg(F.count("*").alias("total"), F.count_if(row_failed()).alias("fail"))
    good = E.percent(F.col("total") - F.col("fail"), F.col("total"))
    return out.withColumn("yield_percent", F.round(good, 6)).orderBy(*by, "x", "y")


def process_windows(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """A11 in the order O3. cp is the smaller distance of the mean to a limit over three sigma."""
    stats = test_stats(labelled(rows), by).filter("mean IS NOT NULL AND sigma IS NOT NULL AND min IS NOT NULL AND max IS NOT NULL")
    near = F.least(F.col("hi_limit") - F.col("mean"), F.col("mean") - F.col("lo_limit"))
    both = F.col("hi_limit").isNotNull() & F.col("lo_limit").isNotNull() & (F.col("sigma") > 0)
    stats = stats.withColumn("cp", F.round(F.when(both, near / (3 * F.col("sigma"))), 6))
    out = _top(stats, [F.desc("limit_fail"), F.asc_nulls_last("cp"), F.asc("label"), F.asc("test_num")], TOP, by)
    return out.select(*by, "label", *(F.round(c, 6).alias(c) for c in ("mean", "sigma", "min", "max", "lo_limit", "hi_limit")), "limit_fail", "cp")


def data_quality(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """Eight counters over the rows, in one pass; labels in order."""
    checks = {
        "missing limits": F.col("lo_limit").isNull() | F.col("hi_limit").isNull(),
        "missing part_id": F.col("part_id") == "",
        "missing result": F.col("result").isNull(),
        "missing test_pass": F.col("test_pass").isNull(),
        "missing test_time_ms": F.col("test_time_ms").isNull(),
        "missing wafer_id": F.col("wafer_id").isNull(),
        "missing x/y coordinate": F.col("x_coord").isNull() | F.col("y_coord").isNull(),
        "unresolved coordinate identity": F.col("part_merge_key").isNull(),
    }
    one = rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())))
    items = F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"c{i}").alias("fail")) for i, k in enumerate(checks)))
    out = one.select(*by, "total", F.explode(items).alias("k")).select(*by, "k.label", "total", "k.fail")
    good = F.col("total") - F.col("fail")
    out = out.select(*by, "label", "total", good.alias("pass"), "fail", F.round(E.percent(good, F.col("total")), 6).alias("yield_percent"))
    return out.orderBy(*by, "label")


def row_filter(df: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON contains the text, whatever its case."""
    return df.filter(F.lower(F.to_json(F.struct("*"))).contains(text.lower()))
