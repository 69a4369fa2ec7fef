"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_chars, read_ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """A field of a protocol buffer message."""
    if isinstance(value, int):  # and bool
        return _varint(number << 3) + _varint(int(value))
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def write_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the pieces' ids equal to their ranks.

    A piece is its token's bytes mapped to printable characters; its score is its negative rank, so the
    lowest rank merges first. Normalisation is the identity, without a dummy prefix, white-space escapes or
    removal. The unknown piece follows the last rank; gaps in the ranks become unused pieces.
    """
    # numbers of the message fields and enum values in sentencepiece_model.proto
    normal, unknown, unused, bpe = 1, 2, 5, 2
    chars = byte_chars()
    by_rank = {r: "".join(chars[b] for b in t) for t, r in ranks.items()}
    size = max(by_rank) + 1
    out = bytearray()
    for r in range(size):
        kind = normal if r in by_rank else unused
        out += _field(1, _field(1, by_rank.get(r, f"<unused{r}>")) + _field(2, float(-r)) + _field(3, kind))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))
    absent = b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # bos, eos, pad: -1
    trainer = _field(3, bpe) + _field(4, size + 1) + _field(40, size) + absent
    normaliser = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encodes and decodes texts. Each match of the pattern is encoded separately."""

    def __init__(self, model: bytes, pattern: str, remembered: int = 400_000):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.table = [chars[b] for b in range(256)]
        unk = self.pieces.unk_id()
        self.bytes = [
            b"" if i == unk or self.pieces.is_unused(i) else bytes(back[c] for c in self.pieces.id_to_piece(i))
            for i in range(self.pieces.get_piece_size())
        ]
        self.whole = {b: i for i, b in enumerate(self.bytes) if b}
        self.known: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered

    def _learn(self, words: list[str]) -> None:
        """Encode the words not seen before. A word that is a token itself is that token."""
        if len(self.known) > self.remembered:
            self.known.clear()
        mapped, names = [], []
        for word in set(words).difference(self.known):
            raw = word.encode()
            if raw in self.whole:
                self.known[word] = (self.whole[raw],)
            else:
                names.append(word)
                mapped.append("".join([self.table[b] for b in raw]))
        for word, ids in zip(names, self.pieces.encode(mapped, num_threads=1), strict=True):
            self.known[word] = tuple(ids)

    def encode(self, text: str, step: int = 100_000) -> Iterator[list[int]]:
        """The text's ids in lists, of which each covers up to step matches of the pattern."""
        matches = (m.group() for m in self.pattern.finditer(text))
        whole = [self.pattern.findall(text)] if len(text) <= 4 * step else iter(lambda: list(islice(matches, step)), [])
        for words in whole:
            try:
                yield list(chain.from_iterable(map(self.known.__getitem__, words)))
            except KeyError:
                self._learn(words)
                # the cache may have been cleared: learn() then has learnt every word anew
                yield list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _digests(source, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]):
        codec = Codec(source.value, pattern)
        names = [str(i) for i in range(len(codec.bytes))]
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                counts, encoded, decoded = [], [], []
                for text in b.column(1).slice(k, 1024):
                    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in codec.encode(text.as_py() or ""):
                        ids_sha.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                        text_sha.update(codec.decode(ids))
                        n += len(ids)
                    counts.append(n)
                    encoded.append(ids_sha.hexdigest())
                    decoded.append(text_sha.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k, 1024), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _tokens(source, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]):
        codec = Codec(source.value, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                ids = [list(chain.from_iterable(codec.encode(x.as_py() or ""))) for x in b.column(1).slice(k, 256)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 256), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(source, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]):
        codec = Codec(source.value, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                raw = [codec.decode(x.as_py() or []) for x in b.column(1).slice(k, 256)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 256), pa.array(raw, pa.binary())], ["doc_id", "body"])

    return run


def _run(df: DataFrame, id_col: str, value_col: str, kind: str, vocabulary: str | None, make, schema: str) -> DataFrame:
    spark = df.sparkSession
    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    source = spark.sparkContext.broadcast(write_model(ranks))  # as large as the vocabulary
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(value_col).cast(kind).alias("value"))
    return rows.mapInArrow(make(source, public_tokenizers.PATTERN), schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of whole texts; a null text counts as empty, which has no ids."""
    return _run(docs, id_col, text_col, "string", vocabulary, _tokens, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, body) with the bytes of the ids; null ids count as none."""
    return _run(tokens, id_col, ids_col, "array<int>", vocabulary, _texts, "doc_id bigint, body binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids, and return the digests of both.

    Works on one text, and for very long ones on a part of its ids, at a time; nothing is shuffled.

    Cases: a null text counts as empty; empty texts have no tokens. Null or repeated ids pass through.
    Other columns are ignored. An empty table gives an empty result.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _run(docs, id_col, text_col, "string", vocabulary, _digests, schema)
