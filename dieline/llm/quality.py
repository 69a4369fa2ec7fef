"""Quality classifier by importance resampling over hashed n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import MIX, Words, mix
from .scratch import Scratch, bounded

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None, buckets: int, cache: dict) -> np.ndarray:
    """Bucket numbers of a text's lower-cased tokens and of its pairs of adjacent tokens."""
    tokens = _TOKEN.findall((text or "").lower())
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    pairs = mix(h[:-1] * MIX[0] + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        cache, target, raw = Words(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                found = features(text.as_py(), buckets, cache)
                seen, n = np.unique(found, return_counts=True)
                raw[seen] += n
                if wanted.as_py():
                    target[seen] += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(raw[at])], ["k", "target", "raw"])

    return run


def log_weight(found: np.ndarray, good: bool, target: np.ndarray, raw: np.ndarray, sums: tuple[int, int], smooth: float = 1.0) -> float:
    """The sum of the n-grams' log ratios under models without the document itself."""
    seen, n = np.unique(found, return_counts=True)
    own = n if good else 0 * n
    size = len(target) * smooth
    ratio = np.log(target[seen] - own + smooth) - np.log(raw[seen] - n + smooth)
    return float((n * ratio).sum() - n.sum() * (math.log(sums[0] - own.sum() + size) - math.log(sums[1] - n.sum() + size)))


def _weights(table, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        (target, raw), cache = table.value, Words()
        sums = int(target.sum()), int(raw.sum())
        for b in batches:
            pairs = zip(b.column(1), b.column(2), strict=True)
            w = [log_weight(features(x.as_py(), buckets, cache), g.as_py(), target, raw, sums) if sums[0] else 0.0 for x, g in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(w, pa.float64())], ["doc_id", "row", "log_weight"])

    return run


def kth_largest(scores: DataFrame, col: str, k: int, bins: int = 1024, few: int = 4096) -> float:
    """The k-th largest value of a column without nulls, by histograms over ever smaller ranges."""
    low, high = scores.agg(F.min(col), F.max(col)).first()
    while True:
        inside = scores.filter((F.col(col) >= low) & (F.col(col) <= high))
        if high <= low or inside.count() <= few:
            break
        width = (high - low) / bins
        if low + width <= low:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col(col) - low) / width))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for row in sorted(found, reverse=True):
            if row["n"] >= k:
                break
            k -= row["n"]
        if (row["lo"], row["hi"]) == (low, high):
            break
        low, high = row["lo"], row["hi"]
    if high <= low:
        return low
    for value, n in inside.groupBy(col).count().orderBy(F.desc(col)).limit(few).collect():
        k -= n
        if k <= 0:
            break
    return value


def resample(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 15,
    clean_cost: float = 4.0,
    seed: int = 0,
    row_col: str | None = None,
) -> DataFrame:
    """Keep documents by importance weights towards the labelled good ones.

    Two bag-of-n-grams models over hashed words and word pairs are counted: the target over all
    documents labelled quality 1 and not toxic, the raw model over all documents. A document's log weight is
    the sum of the log ratios of its n-grams, its own counts left out of both models, so that labelled
    and other documents compare. Gumbel noise, fixed by id and seed, is added and the k
    highest scores are kept, which samples without replacement in proportion to the weights. k is the
    number of documents whose weight reaches the threshold at which the labelled documents are told
    apart best, a lost good document counting clean_cost times a kept bad one.

    All counts, weights, thresholds and k cover all rows; only histograms of fixed sizes reach the driver.

    Cases: a null or empty text has weight 0. Several labels of an id count as their lowest quality. Without
    labels of either quality every document stays. Documents tied with the k-th score stay. Null ids
    have no label. Other columns are ignored. An empty table gives an empty result.

    Returns doc_id, log_weight, score, kept: one row per input row; with row_col, a number of the rows that holds
    whenever they are read, as row as well.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    row = F.lit(0).cast("bigint") if row_col is None else F.col(row_col).cast("bigint")
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text, row.alias("row"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").dropna(subset=["doc_id", "quality"])
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = bounded(scratch.save(known, "labels"))
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    plain = plain.join(known, "doc_id", "left").select("doc_id", "text", good.alias("good"), "row")
    counted = plain.select("text", "good").mapInArrow(_counts(buckets), "k bigint, target bigint, raw bigint")
    rows = counted.groupBy("k").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()  # at most buckets
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for k, t, r in rows:
        target[k], raw[k] = t, r
    table = spark.sparkContext.broadcast((target, raw))
    weighed = plain.mapInArrow(_weights(table, buckets), "doc_id bigint, row bigint, log_weight double")
    weighed = weighed.drop("row") if row_col is None else weighed
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    weighed = weighed.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform)))
    weighed = scratch.save(weighed, "weighed")

    # labelled documents by quality over bins of the compressed weight
    place = F.floor(F.signum("log_weight") * F.log1p(F.abs("log_weight")) * 64)
    judged = weighed.join(known, "doc_id").groupBy(place.alias("bin")).agg(
        F.sum(good.cast("int")).alias("good"), F.sum((F.col("quality") == 0).cast("int")).alias("bad")
    )
    bins = sorted(judged.collect())
    lost, kept, best = 0, sum(b[2] for b in bins), None
    cost = kept
    for place_, g, b in bins:  # a threshold above this bin
        lost, kept = lost + g, kept - b
        if lost * clean_cost + kept < cost and g + b:
            best, cost = place_ + 1, lost * clean_cost + kept
    if best is None or not any(b[1] for b in bins):
        return weighed.withColumn("kept", F.lit(True))
    edge = math.copysign(math.expm1(abs(best) / 64), best)
    k = weighed.filter(F.col("log_weight") >= edge).count()
    cut = kth_largest(weighed, "score", k) if k else math.inf
    return weighed.withColumn("kept", F.col("score") >= cut)
