"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous steps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encoder, read_json

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(source, size: int, end_id: int):
    """(doc_id, text) batches -> the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]):
        ranks, special = source.value
        encode = encoder(ranks, special, public_tokenizers.PATTERN).encode
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                ids, piece, start, length, crc = [], [], [], [], []
                for doc, text in zip(*(b.slice(k, 1024).column(i) for i in (0, 1)), strict=True):
                    tokens = encode(text.as_py() or "", allowed_special="all")
                    tokens.append(end_id)
                    array, at = np.array(tokens, "<u4"), 0
                    end = len(array) % size or size
                    while at < len(array):
                        ids.append(doc.as_py())
                        piece.append(len(range(0, at, size)))
                        start.append(at)
                        length.append(end - at)
                        crc.append(zlib.crc32(array[at:end].tobytes()))
                        at, end = end, end + size
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = zip((ids, piece, start, length, crc), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over runs of equal lengths and runs of equal gaps.

    One step takes all documents of a length, longest first. A sweep over the sorted gaps finds the
    successor of the length: the smallest gap that holds it. Ranks settle who takes which of a run's
    gaps; the filled gaps form new runs, and the step repeats with the rest. What finds no gap opens
    sequences of as many documents as one holds. That is what sequential best-fit decreasing does
    with single documents. At most size lengths exist, so the runs are few however many documents are.

    Returns (length, rank, count, sequence, per, offset): documents of that length with ranks from
    rank on, per of them to a sequence, from that sequence on, the first of each at that offset.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted
    runs: dict[int, deque[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count)
    used = 0

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                runs[gap] = deque()
                insort(gaps, gap)
            runs[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = size // length
                full, rest = divmod(left, per)
                if full:
                    out.append((length, rank, full * per, used, per, 0))
                    add(size - per * length, used, full)
                if rest:
                    out.append((length, rank + full * per, rest, used + full, rest, 0))
                    add(size - rest * length, used + full, 1)
                used += full + bool(rest)
                break
            gap = gaps[at]
            first, count = runs[gap].popleft()
            # a gap that still is the best fit for the same length takes the next document as well
            per = gap // length
            full = min(count, left // per)
            if full:
                taken, each = full, per
            else:
                taken, each = 1, left
            out.append((length, rank, taken * each, first, each, size - gap))
            rank, left = rank + taken * each, left - taken * each
            if count > taken:
                runs[gap].appendleft((first + taken, count - taken))
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            add(gap - each * length, first, taken)
    return out


def pack(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 0,
    vocabulary: str | None = None,
) -> DataFrame:
    """Pack whole documents into as few sequences of at most size tokens as best fit finds.

    A document's tokens are its ids by the byte-level BPE vocabulary, special tokens of the text
    included, then end_id. Only longer documents are cut: into pieces of size tokens, of which the first may be
    shorter. The pieces are range-sorted by length and ranked without gathering a length in one
    task; best_fit() matches ranks to gaps over at most size runs, and each piece finds its place by
    its rank in the runs.

    Cases: a null or empty text is one token; a text of any length is encoded whole and cut. Equal lengths go by id, piece and content. Rows that repeat or lack an id are packed like any
    other. Other columns are ignored. An empty table gives an empty result.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(read_json(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.save(plain.mapInArrow(_pieces(source, size, end_id), _PIECES), "pieces")

    order = ["length", "doc_id", "piece", "ids_crc32"]
    ranked = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = scratch.save(ranked.withColumn("id", F.monotonically_increasing_id()), "ranked")
    scratch.drop("pieces")
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}  # at most size rows
    part = F.shiftright("id", 33).cast("int")
    sizes = sorted(ranked.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, parts = 0, []
    for p, n in sizes:
        parts.append((p, before))
        before += n
    lower, total = {}, 0
    for length in sorted(counts):
        lower[length] = total
        total += counts[length]

    runs = [(length, rank, rank + n, seq, per, offset) for length, rank, n, seq, per, offset in best_fit(counts, size)]
    lengths = sorted(lower)
    kept = spark.sparkContext.broadcast((dict(parts), lower, {k: [x[1:] for x in runs if x[0] == k] for k in lengths}))

    def place(batches: Iterator[pa.RecordBatch]):
        ahead, below, by_length = kept.value
        starts = {k: np.array([x[0] for x in v]) for k, v in by_length.items()}
        fields = {k: np.array(v, np.int64) for k, v in by_length.items()}
        for b in batches:
            length, ids = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "id"))
            offs = np.array([ahead[p] for p in (ids >> 33).tolist()], np.int64)
            rank = offs + (ids & ((1 << 33) - 1)) - np.array([below[x] for x in length.tolist()], np.int64)
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                run = fields[int(k)][np.searchsorted(starts[int(k)], rank[at], "right") - 1]
                within = rank[at] - run[:, 0]
                seq[at] = run[:, 2] + within // run[:, 3]
                offset[at] = run[:, 4] + within % run[:, 3] * k
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [b.column(b.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECES + ", sequence_id bigint, offset bigint")
