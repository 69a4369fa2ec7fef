"""Exact top-k inner-product search over norm buckets."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bounded

#: Scores pass between tasks as decimals of 38 digits; larger ones are cut to that, and to a long at the end.
_MOST, _LONG = 10**38 - 1, (1 << 63) - 1
_ROOM = 1e-9


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: as doubles where these are exact, else as Python's integers."""
    with np.errstate(over="ignore"):
        wide = np.floor(values * scale)
    if np.abs(wide).max(initial=0) < 2.0**53:
        return wide
    return np.array([int(math.floor(Fraction(float(x)) * scale)) for x in values.ravel()], object).reshape(values.shape)


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of v with those of q: doubles while every sum is below 2 ** 53, else longs, else Python's integers."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    if v.dtype != object and q.dtype != object and most < 2.0**53:
        return v @ q.T
    kind = np.int64 if most < 2.0**62 else object
    return np.array([[int(x) for x in r] for r in v], kind).reshape(v.shape) @ np.array([[int(x) for x in r] for r in q], kind).reshape(q.shape).T


def bucket_top(q: np.ndarray, floor: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, list]]:
    """The vectors of one bucket that can be among the k best of each query: their indexes into v and their scores.

    floor has a score that each query's k best reach at least, or -inf; own and rows number the rows, so that a
    query isn't its own answer. The local threshold is the cosine that the longest vector would need. Above 1 the
    bucket is left out; from 0.5 on the query's largest coordinate bounds the candidates' (coordinate pruning); below
    that only vectors long enough are multiplied (length pruning), those of all such queries at once.
    """
    wide, asked = v.astype(np.float64), q.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        norm, length = np.sqrt((wide * wide).sum(1)), np.sqrt((asked * asked).sum(1))
        order = np.argsort(-norm, kind="stable")
        v, wide, ids, rows, norm = v[order], wide[order], ids[order], rows[order], norm[order]
        safe = bool(np.isfinite(norm).all() and np.isfinite(length).all())
        cosine = np.where((floor > 0) & safe, floor / np.maximum(norm[0] * length, 1e-300), 0.0)
        least = np.where(cosine > 0, floor / np.maximum(length, 1e-300), 0.0) * (1 - _ROOM)
    out: list[tuple[np.ndarray, list]] = [(np.empty(0, np.int64), [])] * len(q)

    def best(k_: int, take: np.ndarray, score: np.ndarray) -> None:
        held = rows[take] != own[k_]
        take, score = take[held], score[held]
        keep = score >= floor[k_] if math.isfinite(floor[k_]) else np.ones(len(take), bool)
        if len(take) > k:
            keep &= score >= np.sort(score)[-k] if score.dtype == object else score >= -np.partition(-score, k - 1)[k - 1]
        take, score = take[keep], score[keep]
        first = sorted(range(len(take)), key=lambda i: (-score[i], ids[take[i]], rows[take[i]]))[:k]
        out[k_] = order[take[first]], [int(score[i]) for i in first]

    near = np.flatnonzero((cosine >= 0.5) & (cosine <= 1 + _ROOM))
    unit = wide / np.maximum(norm, 1e-300)[:, None] if len(near) else wide
    for i in near:
        n = int(np.searchsorted(-norm, -least[i], "right"))
        f = int(np.argmax(np.abs(asked[i])))
        c = asked[i, f] / length[i]
        u = unit[:n, f]
        reach = u * c + np.sqrt(np.maximum(0, 1 - u * u) * max(0.0, 1 - c * c))
        take = np.flatnonzero(reach >= cosine[i] - _ROOM)
        best(int(i), take, products(v[take], q[i : i + 1])[:, 0])
    far = np.flatnonzero(cosine < 0.5)
    if len(far):
        ends = np.searchsorted(-norm, -least[far], "right")
        for at in range(0, len(far), 256):  # a block of scores at a time
            some, n = far[at : at + 256], ends[at : at + 256]
            scores = products(v[: int(n.max(initial=0))], q[some])
            for j, i in enumerate(some):
                best(int(i), np.arange(int(n[j])), scores[: int(n[j]), j])
    return out


def top_k(
    vectors: DataFrame,
    scratch: Scratch,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    shrink: float = 0.9,
    rows: int = 16384,
    queries: int = 2048,
) -> DataFrame:
    """For each vector whose id is divisible by every, the k other vectors with the largest inner products.

    Components x count as floor(scale * x). Vectors are grouped by length: a bucket's lengths differ by a factor of
    shrink at most. A bucket is dealt into blocks of about `rows` vectors and the queries into chunks of
    about `queries`, by hashes of their rows, so a bucket of all vectors is no larger than another. Queries meet blocks in
    three rounds: one block of the longest vectors, then those of the longer half, then the others. Each round
    raises the score that a query's k best reach, and a query goes only to blocks whose longest vector can reach it:
    the list of blocks is a table, and what can't matter is pruned before it is shipped. In a block, bucket_top()
    prunes and verifies; it passes on k rows a query.

    Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. Equal
    scores go by the smaller id. Rows that repeat an id are rows like others: each is a query, and a candidate for the other.
    Vectors are compared with those of the same number of components. Products are exact for any finite values; scores
    beyond a long are given as the nearest long, and those of more than 38 digits are equal. Fewer than
    k others give fewer rows. Other columns are ignored. An empty table gives an empty result.

    Returns query_id, rank, vec_id, score.
    """
    e = F.col("e")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    plain = plain.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size("e") > 0) & ~bad)
    # numbers of rows hold once they are written
    whole = scratch.save(plain.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("e").alias("dim"), "e"), "rows")
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.pow(F.when(F.abs(x) < 1e150, F.ceil(F.abs(x) * scale + 1).cast("double")).otherwise(float("inf")), F.lit(2.0))))
    bucket = F.when(F.col("length") < 1e150, F.floor(F.log("length") / -math.log(shrink))).otherwise(1 << 30).cast("int")
    whole = whole.withColumn("length", length).withColumn("bucket", bucket)
    sizes = whole.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("n") / rows).cast("int")), "sizes")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    held = whole.join(bounded(sizes.select("dim", "bucket", "parts")), ["dim", "bucket"]).select("dim", "bucket", part.alias("part"), "row", "vec_id", "e", "length")
    held = scratch.save(held, "vectors")
    blocks = sizes.select("dim", "bucket", "longest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    top = F.max(F.struct("bucket", "longest", "part")).alias("t")
    firsts = blocks.filter("part = 0").groupBy("dim").agg(top).select("dim", "t.*")
    # the bucket below which half of a dimension's vectors lie
    after = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    middle = sizes.withColumn("longer", F.coalesce(F.sum("n").over(after), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("dim")))
    middle = middle.filter("2 * longer < all").groupBy("dim").agg(F.min("bucket").alias("middle"))
    blocks = blocks.join(firsts.select("dim", F.col("bucket").alias("b0"), F.col("part").alias("p0")), "dim").join(middle, "dim")
    first = (F.col("bucket") == F.col("b0")) & (F.col("part") == F.col("p0"))
    turn = F.when(first, 0).when(F.col("bucket") >= F.col("middle"), 1).otherwise(2)
    blocks = scratch.save(blocks.select("dim", "bucket", "part", "longest", turn.alias("turn")), "blocks")

    count = sizes.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-count // every // queries))
    asked = held.filter(F.pmod("vec_id", F.lit(every)) == 0).select(
        "dim", F.col("row").alias("own"), F.col("vec_id").alias("query_id"), F.col("e").alias("x"), "length",
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.lit(float("-inf")).alias("floor"),
    )
    asked = scratch.save(asked, "asked")
    place = ["dim", "bucket", "part", "chunk"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = {"own": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "row": pa.int64(), "score": pa.decimal128(38, 0)}
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], t) for t in kinds.values()], names=list(kinds))

        def matrix(t: pa.Table, c: str) -> np.ndarray:
            return integers(t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1), scale)

        floor, own = a["floor"].to_numpy(), a["own"].to_numpy()
        ids, numbers, asker = b["vec_id"].to_numpy(), b["row"].to_numpy(), a["query_id"].to_numpy()
        found = bucket_top(matrix(a, "x"), floor, own, matrix(b, "e"), ids, numbers, k)
        at = np.repeat(np.arange(len(own)), [len(t) for t, _ in found])
        to = np.concatenate([t for t, _ in found]).astype(np.int64)
        scores = pa.array([max(-_MOST, min(_MOST, s)) for _, ss in found for s in ss], pa.decimal128(38, 0))
        return pa.table([pa.array(own[at]), pa.array(asker[at]), pa.array(ids[to]), pa.array(numbers[to]), scores], names=list(kinds))

    best = None
    for turn_ in range(3):
        some = blocks.filter(F.col("turn") == turn_)
        if turn_ and some.isEmpty():
            continue
        q = asked.join(bounded(some), "dim").filter((F.col("floor") <= F.col("longest") * F.col("length") * (1 + _ROOM)) | (F.col("longest") == float("inf")) | (F.col("length") == float("inf")))
        q = q.select(*place, "own", "query_id", "x", "floor")
        pairs = bounded(scratch.save(q.select(*place).distinct(), f"pairs{turn_}"))
        v = held.join(pairs, ["dim", "bucket", "part"]).select(*place, "row", "vec_id", "e")
        met = q.groupBy(*place).cogroup(v.groupBy(*place)).applyInArrow(run, "own bigint, query_id bigint, vec_id bigint, row bigint, score decimal(38,0)")
        met = met if best is None else best.unionByName(met)
        rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("row")))
        best = scratch.save(met.withColumn("rank", rank).filter(F.col("rank") <= k).select("own", "query_id", "vec_id", "row", "score"), f"best{turn_}")
        if turn_ < 2:
            least = best.groupBy("own").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
            again = asked.join(least.select("own", "least"), "own", "left")
            asked = scratch.save(again.withColumn("floor", F.coalesce("least", F.lit(float("-inf")))).drop("least"), f"asked{turn_}")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("row")))
    long = F.greatest(F.lit(-_LONG - 1).cast("decimal(38,0)"), F.least(F.lit(_LONG).cast("decimal(38,0)"), "score")).cast("bigint")
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", long.alias("score"))
