"""Stages of the pipeline against brute force."""

import collections
import random

import corpus_pipeline
from sparkloom.llm.repeats import PASSAGE_BYTES as WIDTH

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def texts(rows):
    return sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)


def test_exact_stage(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", "", None, "c d", "A"])) for k in range(40)]
    last = {t or "": (i, t) for i, t in rows}
    assert texts(corpus_pipeline.exact_dedup(spark, table(spark, rows), "")) == sorted(last.values(), key=repr)


def test_suffix_stage(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(200)
    rows = [(1, text(50)), (2, None), (3, ""), (4, passage), (5, passage), (6, text(60)), (7, text(30) + passage)]
    windows = collections.Counter(t[k : k + WIDTH] for _, t in rows if t for k in range(len(t) - WIDTH + 1))
    want = []
    for i, t in rows:
        cut = {k + j for k in range(len(t or "") - WIDTH + 1) if windows[t[k : k + WIDTH]] > 1 for j in range(WIDTH)}
        left = "".join(x for k, x in enumerate(t or "") if k not in cut)
        if left or not t:
            want.append((i, left if t else t))
    assert {i for i, _ in want} == {1, 2, 3, 6, 7}
    assert texts(corpus_pipeline.suffix_dedup(spark, table(spark, rows), "")) == sorted(want, key=repr)


def test_clashing_names_and_empty(spark):
    rows = [(1, "a b", 1, 2, "c", "d", 3, None), (1, "a b", 1, 2, "c", "d", 3, None), (None, None, 1, 2, "c", "d", 3, None), (2, "x" * 600, 1, 2, "c", "d", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, _rid int, _z string, digest string, at int, key string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for name, fn in corpus_pipeline.STAGES[1:4]:
        own = docs if name == "exact dedup" else docs.distinct()
        got = fn(spark, own, "")
        assert got.columns == docs.columns, name
        # the long text repeats within itself, so nothing of it is left after the suffix stage
        assert sorted((r.doc_id or 0, r.runs, r.at) for r in got.collect()) == ([(0, 1, 3), (1, 1, 3)] if name == "suffix dedup" else [(0, 1, 3), (1, 1, 3), (2, 1, 3)]), name
        assert fn(spark, docs.limit(0), "").count() == 0
    from sparkloom.llm.toxicity import drop_toxic

    assert drop_toxic(docs, labels).columns == docs.columns


def test_stages_delete_what_they_staged(spark):
    from sparkloom.llm.common import shared_dir

    docs = table(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    corpus_pipeline.exact_dedup(spark, docs, "").count()
    before = list(corpus_pipeline._SCRATCH.paths)
    corpus_pipeline.near_dedup(spark, docs, "").count()
    assert before and not any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) for p in before)
