"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def exact_dedup(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4096,
    hash_bits: int = 64,
) -> DataFrame:
    """Give each document one collision-free identity and keep the largest id of each identity.

    A text's UTF-8 bytes are cut into blocks of block_bytes. The distinct blocks are sorted and
    numbered; then adjacent pairs of numbers are sorted and numbered in turn, level by level, until a
    document has one number. Two documents have the same level and number exactly when their texts are
    equal: a hash only shortens the sort key, and blocks that share a hash are numbered by their bytes.

    Cases: a null text counts as empty; empty texts are equal to each other. Rows that repeat an id
    are separate documents, of which one is kept. A null id sorts below all others. Other columns are
    ignored. An empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per input row.
    hash_bits exists for tests, which force hash collisions by small values.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # numbers of rows hold once they are written, wherever the rows come from
    base = scratch.save(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), body.alias("body")), "numbered")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes))).cast("int")
    cut = F.substring(F.col("body"), F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    first = F.col("pos") == 0
    blocks = base.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    blocks = blocks.select(
        "rid", "pos", "n",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.unhex(F.sha2("body", 256))).alias("sha"),
        cut.alias("block"),
    )
    key = F.xxhash64("block")
    blocks = blocks.withColumn("h", key if hash_bits >= 64 else F.pmod(key, F.lit(1 << hash_bits)))

    # one row per distinct hash: a hash of one distinct block stands for it
    distinct = blocks.select("h", "block").distinct()
    counted = distinct.groupBy("h").agg(F.count("*").alias("c"))
    names = scratch.save(_numbered(counted, ["h"]), "names0")
    named = blocks.drop("block").join(names.filter("c = 1").select("h", "name"), "h").drop("h")
    shared = names.filter("c > 1").select("h")
    if not shared.isEmpty():
        rest = _numbered(blocks.join(shared, "h", "left_semi").select("h", "block").distinct(), ["h", "block"])
        rest = scratch.save(rest.select("h", "block", (-F.col("name")).alias("name")), "names0_shared")
        named = named.unionByName(blocks.join(rest, ["h", "block"]).drop("h", "block"))
    level0 = scratch.save(named, "level0")

    single = level0.filter("n = 1").select("rid", "doc_id", "sha", F.lit(0).alias("level"), "name")
    longest = level0.agg(F.max("n")).first()[0] or 1
    done, current, level = [], level0.filter("n > 1").select("rid", "pos", "n", "name"), 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = current.groupBy("rid", F.shiftright("pos", 1).alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("r"),
            F.max("n").alias("n"),
        )
        names = scratch.save(_numbered(pairs.select("l", "r").distinct(), ["l", "r"]), f"names{level}")
        merged = pairs.join(names, ["l", "r"])
        merged = merged.select("rid", F.col("at").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"), "name")
        merged = scratch.save(merged, f"level{level}")
        done.append(merged.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        current = merged.filter("n > 1")
    ready = single
    if done:
        ends = done[0]
        for more in done[1:]:
            ends = ends.unionByName(more)
        heads = level0.filter("n > 1 AND pos = 0").select("rid", "doc_id", "sha")
        ready = single.unionByName(heads.join(ends, "rid"))

    same = ["level", "name"]
    groups = ready.groupBy(*same).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("top"))
    groups = scratch.save(groups.filter("group_size > 1"), "groups")  # a table, so that the join can split a hot group
    alone = F.col("group_size").isNull()
    return ready.join(groups, same, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("rid") == F.col("top.rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows from 1 upwards (with gaps between partitions) in the sorted order of their columns."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.withColumn("name", F.monotonically_increasing_id() + 1)
