import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from dieline.llm import bytelevel, packing
from dieline.llm.scratch import Scratch
from dieline.llm.tokens import encoder, read_json, read_ranks

ODD = [
    "", None, " ", "\n\n  \t x", "Ünïcödé ß 漢字 \U0001f600 é", "a" * 5000, "1234567 890", "<|endoftext|> x<|endoftext|>",
    "don't we'll I'VE", "\x00\x7f   ", "the " * 3000, "!!!???---", "   lead", "trail   ",
]


@pytest.fixture(scope="module")
def multi():
    return read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_model_encodes_as_the_reference_library(multi):
    codec = bytelevel.Codec(bytelevel.write_model(multi), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi, special_tokens={})
    r = random.Random(5)
    words = ["the", "Straße", "niño", "ção", "🙂", "\n", "  ", "x1", "don't", "漢", ",", "zzq", "ééé"]
    texts = [x or "" for x in ODD] + ["".join(r.choice(words) + r.choice([" ", "", "\t"]) for _ in range(200)) for _ in range(40)]
    for text in texts:
        ids = [i for part in codec.encode(text, step=50) for i in part]
        assert ids == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_forgetting_words_changes_nothing(multi):
    codec = bytelevel.Codec(bytelevel.write_model(multi), P.PATTERN, remembered=3)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi, special_tokens={})
    for text in ["one two three four five", "six seven eight one", "one two"]:
        assert [i for part in codec.encode(text) for i in part] == own.encode_ordinary(text)


def test_round_trip_rows(spark, multi):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(None, "x", 0), (3, "x", 0)], "doc_id bigint, text string, n_tokens int")
    out = bytelevel.round_trip(df).collect()
    assert len(out) == len(ODD) + 2
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi, special_tokens={})
    for row in out[: len(ODD)]:
        text = ODD[row.doc_id] or "" if row.decoded_sha256 != hashlib.sha256(b"x").hexdigest() else "x"
        ids = own.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ids = bytelevel.encode(df)
    assert {r.body.decode() for r in bytelevel.decode(ids).collect()} == {t or "" for t in ODD} | {"x"}
    assert bytelevel.round_trip(df.limit(0)).collect() == []


def test_encoder_gives_the_ids_of_the_vocabulary_file():
    path = P.path("byte_bpe_50k.json")
    ranks, special = read_json(path)
    own = encoder(ranks, special, P.PATTERN)
    there = Tokenizer.from_file(path)
    for text in ODD:
        if text is not None:
            assert own.encode(text, allowed_special="all") == there.encode(text, add_special_tokens=False).ids
    assert json.load(open(path, encoding="utf-8"))["model"]["type"] == "BPE"


def check_packing(rows, texts, size):
    there = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    whole = {i: [] for i in texts}
    for r in sorted(rows, key=lambda r: r.piece):
        ids = there.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.start == sum(n for _, n in whole[r.doc_id]) and r.piece == len(whole[r.doc_id])
        whole[r.doc_id].append((r.start, r.length))
        assert r.length == size or r.piece == 0
    for i, t in texts.items():
        assert sum(n for _, n in whole[i]) == len(there.encode(t or "", add_special_tokens=False).ids) + 1
    return len(by_sequence)


def test_packing(spark):
    r = random.Random(1)
    texts = dict(enumerate(ODD)) | {100 + i: "word " * r.randrange(0, 90) for i in range(120)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, length int")
    rows = packing.pack(df, Scratch(spark), size=64).collect()
    n = check_packing(rows, texts, 64)
    assert n <= 1.03 * -(-sum(x.length for x in rows) // 64) + 1
    assert packing.pack(df.limit(0), Scratch(spark)).collect() == []
    twice = spark.createDataFrame([(1, "x")] * 5 + [(None, None)] * 3, "doc_id bigint, text string")
    assert len(packing.pack(twice, Scratch(spark)).collect()) == 8


def plain_best_fit(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(size - x)
    return len(gaps)


def test_runs_equal_sequential_best_fit():
    r = random.Random(3)
    for _ in range(200):
        size = r.choice([10, 37, 100])
        lengths = [r.randint(1, size) for _ in range(r.randrange(0, 150))]
        counts = {x: lengths.count(x) for x in lengths}
        runs = packing.best_fit(counts, size)
        used = {}
        for length, rank, n, seq, per, offset in runs:
            for k in range(n):
                used.setdefault(seq + k // per, []).append((offset + k % per * length, length))
        assert len(used) == plain_best_fit(lengths, size)
        assert sum(len(v) for v in used.values()) == len(lengths)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
