"""Every operator over one table of odd rows: nulls, empty and long texts, repeated rows and ids, foreign letters, columns of clashing names, no rows."""

import hashlib
from collections import Counter

import pytest

from dieline.llm import bytelevel, licences, lines, naming, near, packing, quality, scoring
from dieline.llm.scratch import Scratch

LONG = " ".join(f"word{i % 977} and, then{i % 13}" for i in range(100_000))
ROWS = [
    (None, None), (None, "a b c d e f"), (1, None), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other text here"), (4, LONG), (5, LONG + " end"),
    (6, "\u00c0\u00c9 \u00f1 \u6f22\u5b57 \u0130\u03a3"), (7, " \t\n "), (8, "x" * 300_000), (-9, "a\u0000b"), (2**62, "a b c d e f"),
]
#: Names that operators use for columns of their own.
CLASH = ["row", "kept", "at", "th", "pos", "cid", "n", "slice", "ids", "digest", "label", "length", "rid", "body", "h", "removed", "all", "path_", "part", "good"]


@pytest.fixture(scope="module")
def odd(spark):
    shape = "doc_id bigint, text string, path string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, f"d/{n}", *["?"] * len(CLASH)) for n, (i, t) in enumerate(ROWS)], shape)


def count(out):
    return Counter((x.doc_id for x in out))


IDS = Counter(i for i, _ in ROWS)


def test_lines(spark, odd):
    out = lines.line_dedup(odd, Scratch(spark)).collect()
    assert count(out) == IDS and all(x.text == t for x in out for t in [x.text] if not x.n_removed)
    # the long text's only line is in a longer one again, the short one in rows of larger ids
    assert {x.doc_id for x in out if x.n_removed} == {5, None, 2**62}


def test_quality(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = quality.resample(odd, labels, Scratch(spark)).collect()
    assert count(out) == IDS and all(x.log_weight == 0 for x in out if x.doc_id in (1, 2, 7))
    same = [x for x in out if x.doc_id == 3]
    assert len({x.score for x in same}) <= 2 and len({(x.score, x.kept) for x in same}) == len({x.score for x in same})


def test_bytes(odd):
    out = bytelevel.round_trip(odd).collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert Counter((x.doc_id, x.decoded_sha256) for x in out) == want


def test_copies(spark, odd):
    out = naming.exact_dedup(odd, Scratch(spark)).collect()
    sizes = Counter(t or "" for _, t in ROWS)
    assert Counter((x.doc_id, x.group_size) for x in out) == Counter((i, sizes[t or ""]) for i, t in ROWS)
    assert sum(x.kept for x in out) == len(sizes) and {x.keep_id for x in out if x.group_size == 4} == {2, 2**62}


def test_pieces(spark, odd):
    out = packing.pack(odd, Scratch(spark)).collect()
    assert Counter(x.doc_id for x in out if x.piece == 0) == IDS and all(x.length == 1 for x in out if x.doc_id in (1, 2))
    assert all(x.length <= 2048 and x.offset + x.length <= 2048 for x in out)


def test_licences(spark, odd):
    out = licences.licence_scan(odd, Scratch(spark)).collect()
    assert count(out) == IDS and all(x.licence is None for x in out)


def test_groups(spark, odd):
    out = near.near_dedup(odd, Scratch(spark)).collect()
    by = {(x.doc_id, x.n_shingles): x for x in out}
    assert count(out) == IDS and all(x.component_id is None for x in out if x.doc_id is None)
    assert {x.component_id for x in out if x.doc_id in (4, 5)} == {4} and by[1, 0].component_id == 1 and by[2**62, 2].component_id == 3


def test_scores(spark, odd):
    out = scoring.lm_score(odd, Scratch(spark)).collect()
    assert count(out) == IDS and {x.n_tokens for x in out if x.doc_id in (4, 5)} == {300_000, 300_001}
    assert all(x.per_token is None for x in out if x.doc_id in (1, 2, 7)) and all(x.log_probability < 0 for x in out if x.n_tokens)


def test_no_rows(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    runs = [
        lines.line_dedup(none, Scratch(spark)), quality.resample(none, labels, Scratch(spark)), bytelevel.round_trip(none), naming.exact_dedup(none, Scratch(spark)),
        packing.pack(none, Scratch(spark)), licences.licence_scan(none, Scratch(spark)), near.near_dedup(none, Scratch(spark)), scoring.lm_score(none, Scratch(spark)),
    ]
    assert [x.collect() for x in runs] == [[]] * len(runs)
