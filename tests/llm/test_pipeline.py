"""The stages of the pipeline, each over what the one before kept, against plain versions."""

import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from test_dedup import plain_groups
from test_scores import plain_lines
from test_tokens import check_packing

import corpus_pipeline
from dieline.llm import lines, near, quality
from dieline.llm.near import Words
from dieline.llm.scratch import Scratch

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, kept boolean"


def plain_weights(docs, labels, buckets):
    """log weights of (id, text) rows, by counting everything anew without the row itself."""
    cache = Words()
    found = [Counter(quality.features(t, buckets, cache).tolist()) for _, t in docs]
    good = [labels.get(i) == (1, 0) for i, _ in docs]
    out = []
    for n in range(len(docs)):
        raw = sum((f for k, f in enumerate(found) if k != n), Counter())
        target = sum((f for k, f in enumerate(found) if k != n and good[k]), Counter())
        a, b = sum(target.values()) + buckets, sum(raw.values()) + buckets
        out.append(sum(c * (math.log((target[k] + 1) / a) - math.log((raw[k] + 1) / b)) for k, c in found[n].items()))
    return out


def documents():
    r = random.Random(21)
    good = [f"word{i}" for i in range(150)]
    docs = [(None, None), (1, ""), (2, " \n"), (3, "x " * 5000)]
    for i in range(10, 130):
        bad = i % 4 == 0
        text = "\n".join(" ".join(r.choice(good).upper() + "!!" if bad else r.choice(good) for _ in range(r.randrange(6, 14))) for _ in range(4))
        docs.append((i, text))
    base = docs[-1][1] if (len(docs) - 1) % 4 else docs[-2][1]
    # near copies, an exact one, one that shares its id with a bad document, and one without an id
    docs += [(200, base.replace(base.split()[0], "else", 1)), (201, base), (12, base + " more"), (None, base + " yet more")]
    docs += [(300, "SPAM!! " * 30), (None, "SPAM!! SPAM!! buy!! " * 9), (17, "SPAM!! " * 31)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(10, 100)] + [(300, 0, 1), (None, 1, 0), (11, None, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table that each stage gets, and the last one's result."""
    folder = tmp_path_factory.mktemp("tables")
    docs, labels = documents()
    rows = [(i, t, "en", "s", len(t or ""), 5, False) for i, t in docs]
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], str(folder)).write.parquet(f"{folder}/out-{name}")
        tables.append(spark.read.parquet(f"{folder}/out-{name}"))
    return folder, tables


def pairs(df):
    return Counter((x.doc_id, x.text) for x in df.collect())


def test_columns(stages):
    folder, tables = stages
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert all(x["row"] == 5 and x.n_chars == (None if x.text is None else len(x.text)) for x in tables[2].collect())


def test_weights_by_brute_force(spark):
    docs, labels = documents()
    known = {i: (q, t) for i, q, t in labels if i is not None and q is not None}
    rows = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id bigint, text string, k int")
    out = quality.resample(rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), Scratch(spark), buckets=512, row_col="k").collect()
    got = [x.log_weight for x in sorted(out, key=lambda x: x.row)]
    assert np.allclose(got, plain_weights(docs, known, 512), rtol=1e-9, atol=1e-6)


def test_quality_decides_on_rows(spark, stages):
    folder, tables = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    numbered = Scratch(spark).save(tables[0].selectExpr("doc_id", "text", "monotonically_increasing_id() AS k"), "numbered")
    kept = {x.row for x in quality.resample(numbered, labels, Scratch(spark), row_col="k").filter("kept").collect()}
    assert pairs(tables[1]) == Counter((x.doc_id, x.text) for x in numbered.collect() if x.k in kept)
    left = {x.text for x in tables[1].collect()}
    # a bad row without an id goes, and one that shares a good one's id, which stays
    assert not any((t or "").startswith("SPAM!!") for t in left) and pairs(tables[1])[17, dict(documents()[0])[17]] == 0
    assert any(i == 17 for i, _ in pairs(tables[1])) and None in {i for i, _ in pairs(tables[1])}


def test_lines_by_brute_force(spark, stages):
    _, tables = stages
    rows = tables[1].selectExpr("doc_id", "text", "xxhash64(text) AS h").distinct().collect()
    gone = plain_lines([(x.doc_id, x.text) for x in sorted(rows, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.h))])
    want = Counter()
    for (i, t), n in pairs(tables[1]).items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) if t is not None and gone[i, t] else t
        if not gone[i, t] or left.split():
            want[i, left] += n
    assert pairs(tables[2]) == want


def test_near_by_brute_force(stages):
    _, tables = stages
    rows = list(enumerate(x.text for x in tables[2].collect()))
    groups = plain_groups(rows, 5, 80)
    want = Counter(groups[k][1] for k, _ in rows)
    assert tables[3].count() == len(want)
    texts = Counter(t for _, t in rows)
    label = {}
    for k, t in rows:
        label.setdefault(t, groups[k][1])
    assert sorted(label[x.text] for x in tables[3].collect()) == sorted(want) and all(texts[x.text] for x in tables[3].collect())


def test_packing(stages):
    _, tables = stages
    rows = tables[4].collect()
    texts = Counter(x.text or "" for x in tables[3].collect())
    by_id = {x.doc_id: x.text for x in tables[3].collect()}
    once = {i for i, n in Counter(x.doc_id for x in tables[3].collect()).items() if n == 1 and i is not None}
    assert len({(x.sequence_id, x.offset) for x in rows}) == len(rows) and sum(texts.values()) == sum(x.piece == 0 for x in rows)
    check = [x for x in rows if x.doc_id in once]
    alone = [x.asDict() | {"sequence_id": k, "offset": 0} for k, x in enumerate(check)]
    check_packing([type("R", (), x) for x in alone], {i: by_id[i] for i in once}, 2048)


def test_empty_tables(spark, stages, tmp_path):
    _, tables = stages
    tables[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_stage_leaves_tables_that_its_result_does_not_read(spark):
    """A stage's disk counts beside those before it."""
    words = [f"w{i}" for i in range(60)]
    text = ["\n".join(" ".join(words[k : k + 9 + i % 2]) for k in range(i % 9, 40, 9)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    scratch = Scratch(spark)
    lines.repeated_lines(docs, scratch).collect()
    assert {x.name for x in Path(scratch.root.removeprefix("file:")).iterdir()} == {"gone"}
    scratch = Scratch(spark)
    near.near_dedup(docs, scratch).collect()
    assert {x.name for x in Path(scratch.root.removeprefix("file:")).iterdir() if x.name[:5] not in ("part_", "all_1", "all_2", "all_3")} == {"signed", "final"}


def test_a_written_table_leaves_no_shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for name in (found.getAllFiles().apply(i).getName() for i in range(found.getAllFiles().size())) if name.startswith("shuffle_")}
    was = shuffled()
    saved = Scratch(spark).save(spark.range(1000).repartition(3), "t")
    for _ in range(50):
        if not shuffled() - was:
            break
        time.sleep(0.2)
    assert not shuffled() - was
    assert saved.count() == 1000


def test_lines_stage_counts_every_line(spark, tmp_path, monkeypatch):
    """The order of words that the stage compares lines by rests on all lines of all documents."""
    counted, save = [], Scratch.save

    def seen(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        if name == "steps":
            counted.append(out.agg({"count": "sum"}).first()[0])
        return out

    monkeypatch.setattr(Scratch, "save", seen)
    docs = spark.createDataFrame([(i, f"a b{i} c\nd d e{i}") for i in range(9)], "doc_id bigint, text string")
    assert corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).count() == 9
    assert counted == [9 * 5]


def test_lines_stage_decides_on_rows(spark, tmp_path):
    """A row's lines are repeated ones even if the earlier row has its id and text; rows without words stay."""
    a, b = "one two three four five\nsix seven eight nine ten", "red green blue black white\n\none two three four five"
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "x"), (2, b, "x"), (None, b + " grey\npink", "y"), (None, b + " grey\npink", "y"), (5, None, "x"), (5, None, "x"), (6, " \n", "x"), (6, " \n", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string").repartition(3).write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.dedup_lines(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    assert out.columns == ["doc_id", "text", "a.b"]
    want = [(1, a, "x"), (2, "red green blue black white\n", "x"), (None, "\npink", "y"), (5, None, "x"), (5, None, "x"), (6, " \n", "x"), (6, " \n", "x")]
    assert Counter(map(tuple, out.collect())) == Counter(want)
