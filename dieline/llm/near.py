"""MinHash near-duplicate groups with tensored banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Odd multipliers of the mixing steps.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Words(dict):
    """Word (bytes or str) -> 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, cache: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased and words end at ASCII white space. Fewer words than size make one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * MIX[0] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def half_keys(sets: list[np.ndarray], collections: int, rows: int) -> np.ndarray:
    """2 * collections keys for each set, each from rows MinHash values; the sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, 2 * collections * rows + 1, dtype=np.uint64) * MIX[0])
    keys = np.empty((len(sets), 2 * collections), np.uint64)
    for c in range(2 * collections):
        key = np.full(len(sets), c, np.uint64)
        for r in range(rows):
            v = flat ^ seeds[c * rows + r]
            v *= MIX[1]
            v ^= v >> np.uint64(32)
            v *= MIX[2]
            key = mix(key * MIX[0] + np.minimum.reduceat(v, starts))
        keys[:, c] = key
    return keys


def _signatures(size: int, collections: int, rows: int, block: int = 60_000):
    """(doc_id, text) batches -> doc_id, n_shingles, digest, half."""

    def emit(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        half, digest = [None] * len(ids), [None] * len(ids)
        at = 0
        while at < len(full):  # blocks of some shingles keep the arrays in the CPU's cache
            end, total = at, 0
            while end < len(full) and (end == at or total + len(sets[full[end]]) <= block):
                total += len(sets[full[end]])
                end += 1
            for i, k in zip(full[at:end], half_keys([sets[i] for i in full[at:end]], collections, rows), strict=True):
                half[i] = k.view(np.int64)
                digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            at = end
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(half, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "half"],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        cache = Words()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield emit(part.column(0), [shingles(x.as_py(), size, cache) for x in part.column(1)])

    return run


def _sets(size: int):
    """(doc_id, text, digest, cid) batches -> cid, items, where the text has that digest."""

    def run(batches: Iterator[pa.RecordBatch]):
        cache = Words()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                cids, items = [], []
                for text, digest, cid in zip(*(b.slice(k, 256).column(i) for i in (1, 2, 3)), strict=True):
                    found = shingles(text.as_py(), size, cache)
                    if xxhash.xxh3_128_digest(found.tobytes()) == digest.as_py():
                        cids.append(cid.as_py())
                        items.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["cid", "items"])

    return run


def near_dedup(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    collections: int = 14,
    rows: int = 3,
    words: int = 8,
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Equal sets form a class first. Each class gets two groups of `collections` half keys of `rows`
    MinHash values each; a table key combines one half key of either group, so collections ** 2 tables
    of 2 * rows values cost 2 * collections * rows values. At similarity 0.8 a pair shares no table with
    probability 9e-5 (14 collections of 3 rows), at 0.9 with probability 2e-8. Half keys that only one
    class has are left out before they are combined.

    In a table's bucket every class is verified against the bucket's smallest class, the pivot. A
    class that ends in another component than a pivot of it can still link with other classes of that
    pivot. Those pairs are verified too, except where whole sets rule a link out: a class's overlap
    with another is at most the number of its shingles that occur in a second class of these, less
    those that a bitmap of words * 64 bits shows the other to lack; and by the triangle inequality two classes whose distances to the pivot differ by more than the
    threshold's distance don't link. So no bucket is cut, a bucket of one large group costs one pair
    a member, and every candidate pair is verified, excluded exactly or connected already.
    All similarities are those of whole sets of 64-bit shingle hashes.

    Cases: a text without words (or null) has n_shingles 0 and stands alone. A null id stands alone with a null
    component. Rows that repeat an id share its component if their texts are near. Other columns are
    ignored. An empty table gives an empty result. Of the tables in scratch only those that the result reads and the components' links are left.

    Returns doc_id, n_shingles, component_id, kept: one row per input row.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, digest binary, half array<bigint>"
    signed = scratch.save(plain.mapInArrow(_signatures(shingle, collections, rows), schema), "signed")

    sets = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    classes = sets.agg(F.min("doc_id").alias("doc_id"), F.first("half").alias("half"))
    # in order of their documents: the original, which is most like all its copies, comes before them
    classes = classes.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    halves = classes.select("cid", F.posexplode("half").alias("at", "hk"))
    twice = halves.groupBy("hk").agg(F.count("*").alias("c")).filter("c > 1").select("hk")
    twice = scratch.save(twice, "twice")  # a table, so that the join below can split a hot key
    left = F.col("at") < collections
    both = halves.join(twice, "hk").groupBy("cid").agg(
        F.collect_list(F.when(left, F.col("hk"))).alias("l"), F.collect_list(F.when(~left, F.col("hk"))).alias("r")
    )
    keys = both.select("cid", "r", F.explode("l").alias("a")).select("cid", "a", F.explode("r").alias("b"))
    keys = scratch.save(keys.select("cid", F.xxhash64("a", "b").alias("key")), "keys")
    buckets = keys.groupBy("key").agg(F.min("cid").alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    buckets = scratch.save(buckets.select("key", "pivot"), "buckets")
    members = scratch.save(keys.join(buckets, "key"), "members")
    scratch.drop("twice", "keys", "buckets")

    involved = members.select("cid").distinct().join(classes.select("cid", "doc_id", "digest"), "cid")
    texts = plain.join(involved, "doc_id").select("doc_id", "text", "digest", "cid")
    items = texts.mapInArrow(_sets(shingle), "cid bigint, items array<bigint>").dropDuplicates(["cid"])
    items = scratch.save(items, "items")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a = items.select(F.col("cid").alias("a"), F.col("items").alias("x"))
        b = items.select(F.col("cid").alias("b"), F.col("items").alias("y"))
        size = F.size(F.array_intersect("x", "y")).cast("bigint")
        out = pairs.join(a, "a").join(b, "b").select("a", "b", size.alias("i"), (F.size("x") + F.size("y")).alias("s"))
        return scratch.save(out.withColumn("link", F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent), name)

    stars = members.filter("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    first = verified(stars, "first")
    links = first.filter("link").select("a", "b")
    label = scratch.save(components(links, scratch, "part"), "part_label")

    # pairs of classes that share a pivot, of which one isn't connected with it
    named = members.select("cid", "pivot").distinct().filter("cid <> pivot").join(label.withColumnRenamed("node", "cid"), "cid", "left")
    top = label.select(F.col("node").alias("pivot"), F.col("label").alias("top"))
    named = named.withColumn("label", F.coalesce("label", "cid")).join(top, "pivot", "left")
    far = first.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), (1 - F.col("i") / (F.col("s") - F.col("i"))).alias("d"))
    named = scratch.save(named.withColumn("top", F.coalesce("top", "pivot")).join(far, ["cid", "pivot"]), "named")
    scratch.drop("members")
    open_ = scratch.save(named.filter("label <> top").select("pivot").distinct(), "open")
    if not open_.isEmpty():
        around = named.join(open_, "pivot", "left_semi")
        # a class shares at most the shingles that a second class here has as well
        own = around.select("cid").distinct().join(items, "cid").select("cid", F.size("items").alias("n"), F.explode("items").alias("item"))
        twice = scratch.save(own.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1").select("item"), "twice_items")
        bit = F.expr("shiftleft(1L, cast(pmod(item, 64) AS int))")
        word = F.pmod(F.shiftrightunsigned("item", 6), F.lit(words))
        bits = [F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0)).alias(f"b{k}") for k in range(words)]
        can = own.join(twice, "item").groupBy("cid").agg(F.count("*").alias("e"), F.first("n").alias("n"), *bits)
        can = scratch.save(can.filter(F.col("e") * 100 >= F.col("n") * percent), "can")
        around = scratch.save(around.join(can, "cid"), "around")
        odd = around.filter("label <> top")
        other = around.select("pivot", *(F.col(c).alias(f"o_{c}") for c in ("cid", "label", "top", "d", *can.columns[1:])))
        near = (F.col("label") != F.col("o_label")) & (F.abs(F.col("d") - F.col("o_d")) <= 1 - percent / 100 + 1e-9)
        masks = [(F.col(f"b{k}"), F.col(f"o_b{k}")) for k in range(words)]
        lone = reduce(add, (F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in masks))
        o_lone = reduce(add, (F.bit_count(y.bitwiseAND(F.bitwise_not(x))) for x, y in masks))
        most = F.least(F.col("e") - lone, F.col("o_e") - o_lone)
        enough = most * (100 + percent) >= (F.col("n") + F.col("o_n")) * percent
        once = (F.col("o_label") == F.col("o_top")) | (F.col("cid") < F.col("o_cid"))
        more = odd.join(other, "pivot").filter(near & enough & once)
        more = more.select(F.greatest("cid", "o_cid").alias("a"), F.least("cid", "o_cid").alias("b")).distinct()
        more = more.join(first.select("a", "b"), ["a", "b"], "left_anti")
        second = verified(scratch.save(more, "more"), "second")
        links = links.unionByName(second.filter("link").select("a", "b"))
        label = components(links, scratch, "all")
    label = classes.select("cid", "digest", "doc_id").join(label.withColumnRenamed("node", "cid"), "cid", "left")
    label = scratch.save(label.withColumn("label", F.coalesce("label", "cid")), "label")
    smallest = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    smallest = scratch.save(smallest, "smallest")
    final = scratch.save(label.join(smallest, "label").select("digest", "component_id"), "final")
    scratch.drop("classes", "items", "first", "part_label", "named", "open", "twice_items", "can", "around", "more", "second", "label", "smallest")
    out = signed.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
