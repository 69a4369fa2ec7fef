"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Label every linked node with the smallest node that it reaches.

    links has the bigint columns a and b, in any direction, repeats and loops allowed. Rounds of large
    and small stars halve path lengths; each round is written, and neither links nor labels ever
    reach the driver; earlier rounds' tables go. A node's links are never gathered: only their minimum is, pre-aggregated.
    Returns (node, label), without nodes that have no link.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}_0")
    seen, turn = _print(edges), 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.save(low, f"{name}_{turn}_low")  # a table, so that the join can split a hot node
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.filter("u <> v").distinct(), f"{name}_{turn}_large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{name}_{turn}")
        scratch.drop(f"{name}_{turn - 1}", f"{name}_{turn}_low", f"{name}_{turn}_large")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    label = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
