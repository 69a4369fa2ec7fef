import hashlib
import random

import pytest

from dieline.llm import naming, near
from dieline.llm.components import components
from dieline.llm.scratch import Scratch


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, bits):
    r = random.Random(2)
    pool = ["", "a", "ab", "é" * 9, "ab" * 40, "ab" * 40 + "c", "c" + "ab" * 40] + ["".join(r.choice("ab") for _ in range(n)) for n in (7, 8, 9, 33, 64, 65)]
    rows = [(i, r.choice(pool)) for i in range(300)] + [(500, None), (7, "ab"), (7, "ab"), (None, "ab"), (None, "only")]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id bigint, text string, sha string, kept boolean")
    out = naming.exact_dedup(df, Scratch(spark), block_bytes=8, hash_bits=bits).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    seen = {}
    for x in out:
        ids = groups[x.text_sha256]
        known = [i for i in ids if i is not None]
        assert x.keep_id == (max(known) if known else None) and x.group_size == len(ids)
        seen.setdefault(x.text_sha256, []).append(x)
    for v in seen.values():
        assert sum(x.kept for x in v) == 1 and all(x.doc_id == x.keep_id for x in v if x.kept)
    assert naming.exact_dedup(df.limit(0), Scratch(spark)).collect() == []


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    label = {}
    for a, b in links:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    while True:
        was = dict(label)
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if was == label:
            break
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {x.node: x.label for x in components(df, Scratch(spark), "t").collect()} == label
    assert components(df.limit(0), Scratch(spark), "t").collect() == []


def plain_groups(rows, size, percent):
    def items(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {i: items(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("collections,rows", [(14, 3), (14, 1)])
def test_near_dedup(spark, collections, rows):
    r = random.Random(6)
    vocabulary = [f"W{i}" for i in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([6, 20, 45]))] for _ in range(12)]
    texts = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "two one"), (7, "É é"), (8, "é é")]
    for i in range(10, 130):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    df = spark.createDataFrame([(i, t, 5, b"") for i, t in texts], "doc_id bigint, text string, cid int, digest binary")
    for size in (2, 5):
        out = near.near_dedup(df, Scratch(spark), shingle=size, collections=collections, rows=rows).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == plain_groups(texts, size, 80)
        assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_near_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    out = near.near_dedup(df, Scratch(spark), shingle=2).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in out) == [(0, 0, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert near.near_dedup(df.limit(0), Scratch(spark)).collect() == []
