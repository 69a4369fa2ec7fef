"""Masked pseudo-likelihood scores by a bidirectional window network."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import MIX, Words, mix
from .scratch import Scratch

#: Kinds of neighbours (the inputs), classes of words (the outputs), and the least and the most slots of words.
KINDS, CLASSES, SLOTS = 4096, 128, (1 << 16, 1 << 22)
#: Tokens on either side, hidden units, tokens that pass the network at once, and that are held at once beside a whole text.
SIDE, UNITS, STEP, HELD = 2, 24, 8192, 1 << 19
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
_CHUNK = 8192


def token_ids(text: str | None, cache: Words) -> np.ndarray:
    """32 bits of the hashes of the words, A-Z lower-cased, split at ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)).astype(np.uint32).view(np.int32)


class Vocabulary:
    """What slots of words mean, from their counts over the corpus.

    A word's slot is its hash. The most frequent slots, half as many as there are classes, are classes of their own;
    the others fill the rest of the classes in order of frequency, each with the same share of all occurrences. A
    neighbour's kind is its own for the most frequent half of the kinds, else by hash.
    """

    def __init__(self, counts: np.ndarray):
        slots = len(counts)
        smooth = counts + 1.0
        order = np.argsort(-counts, kind="stable")
        own = CLASSES // 2
        mass = np.cumsum(smooth[order[own:]])
        self.classes = np.empty(slots, np.uint8)
        self.classes[order[:own]] = np.arange(own)
        self.classes[order[own:]] = own + np.minimum((mass - 0.5) / mass[-1] * (CLASSES - own), CLASSES - own - 1).astype(np.uint8)
        half = KINDS // 2
        self.kinds = np.empty(slots, np.uint16)
        self.kinds[order[:half]] = 1 + np.arange(half)
        self.kinds[order[half:]] = 1 + half + (mix((order[half:].astype(np.uint64) + np.uint64(1)) * MIX[0]) % np.uint64(KINDS - half - 1)).astype(np.uint16)
        whole = np.bincount(self.classes, smooth, CLASSES)
        self.prior = np.log(whole) - math.log(whole.sum())
        self.within = (np.log(smooth) - np.log(whole)[self.classes]).astype(np.float32)

    def slots(self, ids: np.ndarray) -> np.ndarray:
        return ids.view(np.uint32) & np.uint32(len(self.classes) - 1)


def start_weights(prior: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Small random weights; before any training, classes have their share of the corpus."""
    r = np.random.default_rng(seed)
    w0, w2 = r.normal(size=(len(_OFFSETS), KINDS, UNITS)) * 0.1, r.normal(size=(UNITS, CLASSES)) * 0.05
    return [x.astype(np.float32) for x in (w0, np.zeros(UNITS), w2, prior)]


def windows(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of several texts in one row, with kind 0 between and around them, and where their tokens stand."""
    row = np.zeros(sum(map(len, kinds)) + SIDE * (len(kinds) + 1), np.int64)
    spots, at = [], SIDE
    for k in kinds:
        row[at : at + len(k)] = k
        spots.append(np.arange(at, at + len(k)))
        at += len(k) + SIDE
    return row, np.concatenate(spots) if spots else np.empty(0, np.int64)


def forward(w: list[np.ndarray], around: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hidden units and logits of the classes of tokens with these neighbours."""
    hidden = w[0][0][around[0]]
    for k in range(1, len(around)):
        hidden += w[0][k][around[k]]
    hidden += w[1]
    np.tanh(hidden, out=hidden)
    out = hidden @ w[2]
    out += w[3]
    out -= out.max(1, keepdims=True)
    return hidden, out


def log_probabilities(w: list[np.ndarray], around: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """The log-probability of each token's class given its neighbours."""
    _, out = forward(w, around)
    own = out[np.arange(len(target)), target]
    return own - np.log(np.exp(out, out=out).sum(1))


def add_gradient(w: list[np.ndarray], around: list[np.ndarray], target: np.ndarray, total: list[np.ndarray]) -> float:
    """Add the gradient of the summed cross-entropy, in double precision; returns the cross-entropy."""
    hidden, d = forward(w, around)
    rows = np.arange(len(target))
    own = d[rows, target]
    sums = np.exp(d, out=d).sum(1)
    loss = float((np.log(sums) - own).sum(dtype=np.float64))
    d /= sums[:, None]
    d[rows, target] -= 1
    total[2] += hidden.astype(np.float64).T @ d.astype(np.float64)
    total[3] += d.sum(0, dtype=np.float64)
    back = (d @ w[2].T) * (1 - hidden * hidden)
    total[1] += back.sum(0, dtype=np.float64)
    for k, kinds in enumerate(around):
        for u in range(UNITS):
            total[0][k][:, u] += np.bincount(kinds, back[:, u], KINDS)
    return loss


class Steps:
    """Adam's steps from summed gradients; the rate falls from round to round."""

    def __init__(self, w: list[np.ndarray], rate: float, rounds: int):
        self.w, self.rate, self.rounds, self.turn = w, rate, rounds, 0
        self.first, self.second = ([np.zeros(x.shape) for x in w] for _ in range(2))

    def step(self, gradient: list[np.ndarray], tokens: int) -> None:
        self.turn += 1
        rate = self.rate * (1 - 0.9 * (self.turn - 1) / self.rounds)
        for k, g in enumerate(gradient):
            g = g / tokens
            self.first[k] = 0.8 * self.first[k] + 0.2 * g
            self.second[k] = 0.9 * self.second[k] + 0.1 * g * g
            move = self.first[k] / (1 - 0.8**self.turn) / (np.sqrt(self.second[k] / (1 - 0.9**self.turn)) + 1e-7)
            self.w[k] = (self.w[k] - rate * move).astype(np.float32)


def _encode(batches: Iterator[pa.RecordBatch]):
    cache = Words()

    def batch(docs, ids, slices):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(slices, pa.int32())], ["doc_id", "ids", "slice"])

    for b in batches:
        docs, ids, slices, held = [], [], [], 0
        for doc, text, part in zip(*b.columns, strict=True):
            docs.append(doc.as_py())
            ids.append(token_ids(text.as_py(), cache))
            slices.append(part.as_py())
            held += len(ids[-1])
            if held >= HELD:
                yield batch(docs, ids, slices)
                docs, ids, slices, held = [], [], [], 0
        if docs:
            yield batch(docs, ids, slices)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of a list column as arrays, in groups of about HELD tokens, with the first row's number."""
    values, ends = column.flatten().to_numpy(), np.cumsum(np.concatenate([[0], column.value_lengths().fill_null(0).to_numpy()]))
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + HELD, "right")) - 1)
        yield start, [values[ends[i] : ends[i + 1]] for i in range(start, end)]
        start = end


def _count(slots: int):
    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(slots, np.int64)
        for b in batches:
            counts += np.bincount(b.column(0).flatten().to_numpy().view(np.uint32) & np.uint32(slots - 1), minlength=slots)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    return run


def _gradients(state):
    """The task's gradient, in chunks: (part, lot, values), and the number of its tokens as part -1."""

    def run(batches: Iterator[pa.RecordBatch]):
        words, w = state.value
        total, tokens = [np.zeros(x.shape) for x in w], 0
        for b in batches:
            for _, texts in _texts(b.column(0)):
                slots = [words.slots(t) for t in texts]
                row, spots = windows([words.kinds[s] for s in slots])
                target = words.classes[np.concatenate(slots)]
                for k in range(0, len(spots), STEP):
                    at = spots[k : k + STEP]
                    add_gradient(w, [row[at + o] for o in _OFFSETS], target[k : k + STEP], total)
                tokens += len(spots)
        if tokens:
            flat = np.concatenate([x.ravel() for x in total])
            parts = [flat[k : k + _CHUNK] for k in range(0, len(flat), _CHUNK)] + [np.array([float(tokens)])]
            lot = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array([*range(len(parts) - 1), -1], pa.int32()), pa.array([lot] * len(parts), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["part", "lot", "values"]
            )

    return run


def _sum(key, table):
    """Rows of one part (of one lot) become their sum."""
    values = table["values"].combine_chunks()
    whole = values.flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([whole], pa.list_(pa.float64()))], names=["part", "lot", "values"])


def _score(state):
    def run(batches: Iterator[pa.RecordBatch]):
        words, w = state.value
        for b in batches:
            for first, texts in _texts(b.column(1)):
                slots = [words.slots(t) for t in texts]
                row, spots = windows([words.kinds[s] for s in slots])
                flat = np.concatenate(slots)
                each = np.empty(len(flat))
                for k in range(0, len(spots), STEP):
                    at = spots[k : k + STEP]
                    each[k : k + STEP] = log_probabilities(w, [row[at + o] for o in _OFFSETS], words.classes[flat[k : k + STEP]])
                each += words.within[flat]
                sizes = [len(t) for t in texts]
                ends = np.cumsum([0, *sizes])
                sums = [float(each[a:z].sum()) for a, z in zip(ends, ends[1:], strict=False)]
                docs = b.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([docs, pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_tokens", "log_probability"])

    return run


def lm_score(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12, rate: float = 0.15) -> DataFrame:
    """Score documents by masked pseudo-likelihood under a network trained on all of their tokens.

    The network predicts a token's class from SIDE tokens on either side; the probability of a word
    within its class is its share of the class's occurrences. Words are hashed to slots, of which there are the more the
    more tokens there are: an eighth of their number, from 2 ** 16 to 2 ** 22; the slots' counts over
    all documents make the classes (Vocabulary). Documents are split by a hash into as many slices as there are
    rounds; each round sums the gradients of all tokens of one slice, at the same weights, and takes one step, so
    every token trains once and the result doesn't depend on how rows lie in partitions (up to rounding). A last
    pass scores every token of every document.

    Cases: a null or empty text has no tokens and a log-probability of 0. Null or repeated ids pass
    through. A text of any length is one row, whose tokens pass the network in steps. Equal texts have equal scores. Other columns are ignored. An empty table gives an empty result.

    Returns doc_id, n_tokens, log_probability (the sum), per_token (null without tokens).
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int"))
    tokens = scratch.save(plain.mapInArrow(_encode, "doc_id bigint, ids array<int>, slice int"), "tokens", by=("slice",))
    total = tokens.agg(F.sum(F.size("ids").cast("bigint"))).first()[0] or 0
    slots = max(SLOTS[0], min(SLOTS[1], 1 << max(0, (total // 8 - 1).bit_length())))
    counted = tokens.select("ids").mapInArrow(_count(slots), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(slots)
    found = scratch.save(counted, "counts").toArrow()  # at most SLOTS[1] rows
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    words = Vocabulary(counts)
    steps = Steps(start_weights(words.prior), rate, rounds)
    shape = "part int, lot int, values array<double>"
    for k in range(rounds if total else 0):
        state = spark.sparkContext.broadcast((words, steps.w))
        parts = tokens.filter(F.col("slice") == k).select("ids").mapInArrow(_gradients(state), shape)
        lots = parts.groupBy("part", "lot").applyInArrow(_sum, shape)
        sums = scratch.save(lots.groupBy("part").applyInArrow(_sum, shape), f"gradient{k}").toArrow()  # as many values as there are weights
        state.unpersist()
        if sums.num_rows:
            by_part = dict(zip(sums["part"].to_pylist(), sums["values"].combine_chunks(), strict=True))
            flat = np.concatenate([by_part[p].values.to_numpy() for p in range(len(by_part) - 1)])
            ends = np.cumsum([x.size for x in steps.w])[:-1]
            steps.step([g.reshape(x.shape) for g, x in zip(np.split(flat, ends), steps.w, strict=True)], int(by_part[-1].values[0].as_py()))
        scratch.drop(f"gradient{k}")
    state = spark.sparkContext.broadcast((words, steps.w))
    out = tokens.select("doc_id", "ids").mapInArrow(_score(state), "doc_id bigint, n_tokens bigint, log_probability double")
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))
