import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dieline.llm import licences, lines, quality, scoring
from dieline.llm.near import Words
from dieline.llm.scratch import Scratch


def plain_lines(docs, percent=80):
    """Removed line numbers of each (id, text), given in order, by comparing all pairs of lines; rows that repeat both count once."""
    seen, out = [], {}
    for i, text in docs:
        gone = []
        if (i, text) in out:
            continue
        for pos, line in enumerate((text or "").split("\n")):
            s = {w for w in re.split(r"[ \t\n\x0b\x0c\r]+", line.lower()) if w}
            if s:
                if any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                    gone.append(pos)
                seen.append(s)
        out[i, text] = gone
    return out


def line_docs(r):
    vocabulary = [f"{c}{i}" for i in range(30) for c in "wÉ"]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 6, 12, 30, 80]))] for _ in range(25)]
    docs = [(0, None), (1, ""), (2, "\n \n"), (3, "same line\nsame line"), (4, "Same\tLINE"), (4, "same line\r\x0b"), (4, "same line\r\x0b"), (None, "same line\n"), (None, None)]
    for i in range(10, 70):
        text = []
        for _ in range(r.randrange(1, 6)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 8])):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            text.append(r.choice([" ", "\t", " \x0b", "\x0c", "\r "]).join(r.choice([w, w.lower()]) for w in line))
        docs.append((r.choice([i, i, 40]), "\n".join(text)))
    return docs


@pytest.mark.parametrize("options", [{}, {"dense": 0}, {"near_keys": 1, "buckets": 1024, "percent": 70}])
def test_line_dedup(spark, options):
    docs = line_docs(random.Random(8))
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id bigint, text string, n_removed int, removed string")
    ordered = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").distinct().collect()
    ordered = sorted(ordered, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.h))
    want = plain_lines([(x.doc_id, x.text) for x in ordered], options.get("percent", 80))
    found = lines.line_dedup(df, Scratch(spark), **options).collect()
    left = {k: "\n".join(line for n, line in enumerate((k[1] or "").split("\n")) if n not in v) if v else k[1] for k, v in want.items()}
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]), x[2] or "")
    assert sorted(((x.doc_id, x.removed, x.text) for x in found), key=key) == sorted(((i, want[i, t], left[i, t]) for i, t in docs), key=key)
    assert all(x.n_removed == len(x.removed) for x in found)
    kept = lines.without_repeated_lines(df, Scratch(spark), **options)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} >= {0, 1, 2, 3}
    assert lines.line_dedup(df.limit(0), Scratch(spark)).collect() == []


def test_line_dedup_of_a_long_text(spark):
    long = "\n".join(f"line {i} of a long text with words a{i} b{i} c{i} d{i}" if i % 10 else "the same line again and again" for i in range(100_000))
    df = spark.createDataFrame([(1, "The same line again and again"), (2, long)], "doc_id bigint, text string")
    out = {x.doc_id: x for x in lines.line_dedup(df, Scratch(spark)).collect()}
    assert out[1].n_removed == 0 and out[2].n_lines == 100_000 and out[2].removed == list(range(0, 100_000, 10))


@pytest.mark.parametrize("share", [1, 1 << 40])
def test_line_dedup_whatever_the_counted_share(spark, share):
    docs = [(i, t) for i, (_, t) in enumerate(line_docs(random.Random(3)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = lines.repeated_lines(df, Scratch(spark), share=share, dense=1)
    want = {k[0]: v for k, v in plain_lines(docs, 80).items() if v}
    assert {x["at"]: x.removed for x in found.collect()} == want


def test_line_dedup_counts_every_line(spark, monkeypatch):
    """The order of words rests on all lines of all texts, with the options as the queries have them."""
    counted, save = [], Scratch.save

    def seen(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        if name == "steps":
            counted.append(out.agg({"count": "sum"}).first()[0])
        return out

    monkeypatch.setattr(Scratch, "save", seen)
    docs = line_docs(random.Random(5))
    lines.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark))
    words = (re.split(r"[ \t\x0b\x0c\r]+", line.lower()) for _, t in docs for line in (t or "").split("\n"))
    assert counted == [sum(len({w for w in x if w}) for x in words)]


def test_line_dedup_orders_tokens_of_first_lines_only(spark, monkeypatch):
    """Repeated lines are found by their hashes; no table of all lines has tokens."""
    saved, save = {}, Scratch.save

    def seen(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        saved[name] = (out.columns, out.count())
        return out

    monkeypatch.setattr(Scratch, "save", seen)
    docs = [(i, f"one two three four w{i % 3}\nfour one w{i % 3} three two\n \nother words in one line {i}") for i in range(30)]
    found = lines.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark))
    assert {x["at"]: x.removed for x in found.collect()} == {k[0]: v for k, v in plain_lines(docs).items() if v}
    assert saved["words"][1] == 120 and [k for k, (columns, _) in saved.items() if "p" in columns and "first" in columns] == ["classes"]
    assert saved["classes"][1] == 33 and "lines" not in saved


@pytest.mark.parametrize("copies", [2, 40])
def test_line_dedup_makes_stars_for_many_similar_lines_only(spark, monkeypatch, copies):
    """Few similar pairs are found by the join of prefixes alone; the result is the same whole one."""
    saved, save = {}, Scratch.save

    def seen(self, df, name, *args, **more):
        saved[name] = df.columns
        return save(self, df, name, *args, **more)

    monkeypatch.setattr(Scratch, "save", seen)
    base = [f"common{k}" for k in range(20)]
    docs = [(i, " ".join([*base[: i % 20], f"odd{i}", *base[i % 20 + 1 :]]) if i < copies else " ".join(f"w{i}x{k}" for k in range(9))) for i in range(60)]
    found = lines.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark))
    want = {k[0]: v for k, v in plain_lines(docs).items() if v}
    assert {x["at"]: x.removed for x in found.collect()} == want and len(want) >= copies - 1
    assert ("keys" in saved, "stars" in saved) == (copies == 40,) * 2 and "far_pairs" in saved


def test_line_dedup_shuffles_classes_once(spark, monkeypatch):
    """Lines become classes without a shuffle of their prefixes; the join of prefixes deals its rows out once, whole sets aside, and its shorter side is filtered after that."""
    plans, save = {}, Scratch.save

    def seen(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        plans[name] = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        return out

    monkeypatch.setattr(Scratch, "save", seen)
    docs = [(i, t) for i, (_, t) in enumerate(line_docs(random.Random(4)))]
    found = lines.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark), dense=1)
    assert {x["at"]: x.removed for x in found.collect()} == {k[0]: v for k, v in plain_lines(docs, 80).items() if v}
    assert "Exchange hashpartitioning" not in plans["classes"]
    plan = [re.sub(r"#\d+L?|plan_id=\d+|^[ :+-]*", "", x) for x in plans["far_pairs"].splitlines()]
    left, right = (n for n, x in enumerate(plan) if "REPARTITION_BY_COL" in x)
    assert plan[left : left + 4] == plan[right : right + 4] and any("monotonically_increasing_id" in x for x in plan[:left])
    assert not any(re.search(r"\bt#", x) for x in plans["late_thick"].splitlines() if "Generate posexplode" in x)


def test_quality_on_held_out_labels(spark):
    r = random.Random(9)
    good = [f"good{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join((r.choice(good).upper() + "!!") if bad else r.choice(good) for _ in range(r.randrange(5, 60)))
        rows.append((i, text, bad))
        if i % 2:
            labels.append((i, int(not bad), 0))
    df = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (None, "")], "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = {x.doc_id: x.kept for x in quality.resample(df, known, Scratch(spark)).collect()}
    held = [(i, bad) for i, _, bad in rows if i % 2 == 0]
    assert np.mean([out[i] != bad for i, bad in held]) > 0.97
    assert all(x.kept for x in quality.resample(df, known.limit(0), Scratch(spark)).collect())
    assert quality.resample(df.limit(0), known, Scratch(spark)).collect() == []


def test_kth_largest(spark):
    r = random.Random(10)
    values = [r.choice([r.gauss(0, 1), 5.0, -3.0, 1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 1500, 3000):
        assert quality.kth_largest(df, "v", k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]


def sentences(seed=11):
    r = random.Random(seed)
    pairs = {f"a{i}": f"b{i}" for i in range(20)}
    docs = [(i, " ".join(w for _ in range(40) for k in [r.choice(list(pairs))] for w in (k, pairs[k], "and"))) for i in range(1500)]
    mixed = docs[0][1].split()
    r.shuffle(mixed)
    return docs, " ".join(mixed)


def test_training_learns_whatever_the_partitions(spark):
    docs, mixed = sentences()
    docs += [(9000, mixed), (9000, mixed), (9001, None), (9002, ""), (9003, "A1"), (None, "a1 b1 and " * 60_000)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id bigint, text string, ids string, slice int")
    one = scoring.lm_score(df.repartition(1), Scratch(spark)).collect()
    many = scoring.lm_score(df.repartition(7, "text"), Scratch(spark)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0)
    one, many = sorted(one, key=key), sorted(many, key=key)
    assert len(one) == len(docs)
    assert all(x.n_tokens == y.n_tokens and abs((x.per_token or 0) - (y.per_token or 0)) < 1e-6 for x, y in zip(one, many, strict=True))
    by = {x.doc_id: x for x in one}
    assert by[9001].n_tokens == by[9002].n_tokens == 0 and by[9001].log_probability == 0 and by[9002].per_token is None
    assert by[9003].n_tokens == 1 and by[None].n_tokens == 180_000
    assert np.mean([by[i].per_token for i in range(1500)]) > by[9000].per_token + 0.3
    assert scoring.lm_score(df.limit(0), Scratch(spark)).collect() == []


def brute_score(ids, words, w):
    """The sum of the tokens' log-probabilities, one by one."""
    slots = [int(x) for x in words.slots(ids)]
    kinds = [0] * scoring.SIDE + [int(words.kinds[s]) for s in slots] + [0] * scoring.SIDE
    total = 0.0
    for t, slot in enumerate(slots):
        around = [kinds[t + k] for k in range(2 * scoring.SIDE + 1) if k != scoring.SIDE]
        hidden = np.tanh(sum(w[0][k][a].astype(float) for k, a in enumerate(around)) + w[1])
        logits = hidden @ w[2].astype(float) + w[3]
        total += logits[words.classes[slot]] - np.log(np.exp(logits).sum()) + words.within[slot]
    return total


def test_score_and_gradient_by_the_definition(spark):
    docs, mixed = sentences()
    cache = Words()
    texts = [mixed, "", "a1", "new words here a1 b1", docs[3][1]]
    ids = [scoring.token_ids(t, cache) for t in texts]
    counts = np.bincount(np.concatenate([scoring.token_ids(t, cache).view(np.uint32) & np.uint32(0xFFFF) for _, t in docs]), minlength=1 << 16).astype(float)
    words = scoring.Vocabulary(counts)
    assert len(set(words.classes.tolist())) == scoring.CLASSES or counts.astype(bool).sum() < scoring.CLASSES
    assert abs(sum(math.exp(words.within[s]) for s in np.flatnonzero(words.classes == 3)) - 1) < 1e-4
    r = np.random.default_rng(2)
    w = [x + (r.normal(size=x.shape) * 0.1).astype(np.float32) for x in scoring.start_weights(words.prior)]
    state = spark.sparkContext.broadcast((words, w))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(ids)], "doc_id bigint, ids array<int>")
    out = {x.doc_id: x for x in rows.mapInArrow(scoring._score(state), "doc_id bigint, n_tokens bigint, log_probability double").collect()}
    for i, x in enumerate(ids):
        assert out[i].n_tokens == len(x) and abs(out[i].log_probability - brute_score(x, words, w)) < 1e-4 * max(1, len(x))

    got = rows.select("ids").repartition(2).mapInArrow(scoring._gradients(state), "part int, lot int, values array<double>").collect()
    assert sum(x["values"][0] for x in got if x.part == -1) == sum(map(len, ids))
    whole = {}
    for x in got:
        whole[x.part] = whole.get(x.part, 0) + np.array(x["values"])
    flat = np.concatenate([whole[k] for k in range(len(whole) - 1)])
    ends = np.cumsum([x.size for x in w])[:-1]
    gradient = [g.reshape(x.shape) for g, x in zip(np.split(flat, ends), w, strict=True)]
    common = int(words.kinds[words.slots(scoring.token_ids("and", cache))[0]])
    for k, at in ((0, (1, common, 3)), (1, (5,)), (2, (4, 7)), (3, (0,))):
        up, down = ([x.astype(np.float64).copy() for x in w] for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (sum(-brute_score(x, words, up) for x in ids) - sum(-brute_score(x, words, down) for x in ids)) / 2e-4
        assert abs(slope - gradient[k][at]) < 1e-2 * max(1, abs(slope))


def test_licences_and_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x.c", "int main"), (3, "a/b/c/y.c", "// Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "a/b/c/d/z.c", "code"),
        (6, "other/f.c", "the code of the version"), (7, None, None), (8, "top.c", ""), (2, "a/b/x.c", "int main"),
    ]
    df = spark.createDataFrame([(i, p, t, 1) for i, p, t in rows] + [(100 + i, "q/w.c", "some other words here", 1) for i in range(50)], "doc_id bigint, path string, text string, own int")
    out = {x.doc_id: (x.licence, x.origin, x.from_path) for x in licences.licence_scan(df, Scratch(spark)).collect()}
    assert out[1] == ("MIT", "own", "a/LICENSE") and out[2] == ("MIT", "inherited", "a/LICENSE")
    assert out[3] == ("Apache-2.0", "own", "a/b/c/y.c") and out[5] == ("GPL-3.0", "inherited", "a/b/c/COPYING")
    assert out[6] == out[7] == out[8] == (None, None, None)
    assert licences.licence_scan(df.limit(0), Scratch(spark)).collect() == []


GNU = """/* This {what} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {name}
 * License as published by the Free Software Foundation; either
 * version {version} of the License, or (at your option) any later version. */"""
WHOLE = [
    ("LGPL-2.1", GNU.format(what="library", name="Lesser General Public", version="2.1")), ("LGPL-3.0", GNU.format(what="library", name="Lesser General Public", version="3")),
    ("GPL-2.0", GNU.format(what="program", name="General Public", version="2")), ("GPL-3.0", GNU.format(what="program", name="General Public", version="3")),
    ("AGPL-3.0", GNU.format(what="program", name="Affero General Public", version="3")), ("ISC", f"ISC License\n\nCopyright (c) 2020, X\n\n{licences._ISC}"),
    ("BSD-2-Clause", f"Copyright (c) 2020, X\nAll rights reserved.\n\n{licences._BSD_TWO}\n\n{licences._BSD_END}"),
    ("BSD-3-Clause", f"Copyright (c) 2020, X\nAll rights reserved.\n\n{licences._BSD_TWO}\n{licences._BSD_NAME}\n\n{licences._BSD_END}"),
    ("MIT", f"The MIT License\n\n{licences._MIT}"), ("MPL-2.0", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. More of it."),
    (None, "the code of the version and the software are used in the public domain of this license text with other words, and müssen wir nicht"),
]


def test_whole_licences_and_headers(spark):
    rows = [(i, f"f{i}/x.c", t) for i, (_, t) in enumerate(WHOLE)]
    rows += [(100, "long/LICENSE", "word other " * 30_000 + WHOLE[0][1] + " more" * 30_000), (101, "long/a", None)] + [(200 + i, None, f"some other words here {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    out = {x.doc_id: x for x in licences.licence_scan(df, Scratch(spark)).collect()}
    assert [out[i].licence for i in range(len(WHOLE))] == [name for name, _ in WHOLE]
    assert out[100].licence == out[101].licence == "LGPL-2.1" and out[101].origin == "inherited" and out[101].from_path == "long/LICENSE"


def test_best_window_by_brute_force():
    r = random.Random(3)
    templates = {"A": ["a b c d", "a b x y z w v"], "B": ["a b c e", "q r s"]}
    vocabulary = sorted({w for v in templates.values() for t in v for w in licences.words(t)})
    idf = {w: 1 + i % 4 for i, w in enumerate(vocabulary)}
    statements = licences._statements(idf, 6.0, templates, 0.75)
    for _ in range(400):
        seq = [r.choice([*vocabulary, "m", "n"]) for _ in range(r.randrange(1, 14))]
        best = 0.0
        for _, size, vector, _ in statements:
            for k in range(max(1, len(seq) - size + 1)):
                v = {w: (1 + math.log(n)) * idf.get(w, 6.0) for w, n in Counter(seq[k : k + size]).items()}
                score = sum(x * vector.get(w, 0.0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()))
                if score >= 0.75:
                    best = max(best, licences.weight(score, size))
        assert abs(licences.weight(*licences.best_window(seq, idf, 6.0, statements, 0.75)[1:]) - best) < 1e-9


def test_licences_over_lines_and_inside_sentences(spark):
    bsd = """/* Copyright (c) 2020, X. All rights reserved.
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met: */"""
    gpl = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version."""
    inside = "The tools of this group were released under the MIT License in March 2020 by the authors."
    texts = [bsd, gpl.format(":", ",", 3), gpl.format(";", ";", 2), inside, "Copyright X.\nAll rights reserved.", "all the rights of the people"]
    df = spark.createDataFrame([(i, "p/f.c", t) for i, t in enumerate(texts + ["some other words here"] * 100)], "doc_id bigint, path string, text string")
    out = {x.doc_id: x.licence for x in licences.licence_scan(df, Scratch(spark)).collect()}
    assert [out[i] for i in range(7)] == ["BSD-3-Clause", "GPL-3.0", "GPL-2.0", "MIT", "All-Rights-Reserved", None, None]
