"""Set joins, ranked retrieval, alias automata and packed tensors against brute force, with skew."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aliases, multipack, retrieval, setjoin, tensors


def sets_of(rng, n, hot):
    out = []
    for k in range(n):
        own = {f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 12))} | ({"the", "and", "of"} if rng.random() < hot else set())
        out.append((k, sorted(own)))
    return out


@pytest.mark.parametrize("threshold", [0.18, 0.5, 0.8, 1.0])
def test_overlap_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    left, right = sets_of(rng, 150, 0.4), [*sets_of(rng, 60, 0.6), (900, ["the", "and", "of"]), (901, None)]
    schema = "id long, words array<string>"
    got = {(r.a, r.b): r.overlap for r in setjoin.overlap_join(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema), threshold).collect()}
    share = lambda x, y: len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0
    assert got == {(a, b): share(x, y) for a, x in left for b, y in right if share(x, y) >= threshold}


def test_a_hot_word_makes_no_pairs(spark):
    schema = "id long, words array<string>"
    left = [(k, ["the", *(f"a{k}x{j}" for j in range(9))]) for k in range(1500)] + [(5000, ["the", "p", "q", "r"])]
    right = [(k, ["the", *(f"b{k}x{j}" for j in range(9))]) for k in range(1500)] + [(5000, ["the", "p", "q", "z"])]
    sides = [spark.createDataFrame(x, schema) for x in (left, right)]
    assert [tuple(r) for r in setjoin.candidate_pairs(*sides, 0.5).collect()] == [(5000, 5000)]
    assert [tuple(r) for r in setjoin.overlap_join(*sides, 0.5).collect()] == [(5000, 5000, 0.75)]


def wanted_matches(queries, docs, k, least, long, topic_boost):
    out = set()
    for q, terms, topic in queries:
        found = []
        for d, own, source, own_topic, boost, prefer in docs:
            base = sum(2 if len(t) >= long else 1 for t in set(terms) & set(own))
            if base >= least:
                found.append((-(base + boost + (topic_boost if topic is not None and topic == own_topic else 0)), not prefer, d, source))
        seen = []
        for score, _, d, source in sorted(found):
            if source not in seen and len(seen) < k:
                seen.append(source)
                out.add((q, d, source, -score, len(seen)))
    return out


@pytest.mark.parametrize("champions", [1, 64])
def test_ranked_matches(spark, champions, monkeypatch):
    monkeypatch.setattr(retrieval, "CHAMPIONS", champions)
    rng = random.Random(champions)
    term = lambda: rng.choice((f"t{rng.randrange(60)}", f"long{rng.randrange(90)}", "the", "and"))
    queries = [(k, [term() for _ in range(rng.randrange(0, 9))], rng.choice(("a", "b", None))) for k in range(40)]
    docs = [(k, sorted({term() for _ in range(rng.randrange(0, 25))}), f"s{rng.randrange(30)}", rng.choice(("a", "b", "c", None)), *rng.choice(((3, True), (0, False), (0, False)))) for k in range(400)]
    q = spark.createDataFrame(queries, "query_id long, terms array<string>, topic string")
    d = spark.createDataFrame(docs, "doc_id long, terms array<string>, source string, topic string, boost int, prefer boolean").repartition(3)
    got = {(r.query_id, r.doc_id, r.source, r.score, r["rank"]) for r in retrieval.top_matches(q, d, 3, 3, 5, topic_boost=4).collect()}
    assert got == wanted_matches(queries, docs, 3, 3, 5, 4)


def test_a_term_of_all_documents_brings_up_none(spark):
    docs = [(k, ["everywhere", f"rare{k // 4}", f"odd{k}"], f"s{k}", "x", 0, False) for k in range(2000)]
    queries = [(k, ["everywhere", f"rare{k}"], None) for k in range(400)]
    q = spark.createDataFrame(queries, "query_id long, terms array<string>, topic string")
    d = spark.createDataFrame(docs, "doc_id long, terms array<string>, source string, topic string, boost int, prefer boolean")
    index = retrieval.TermIndex(d, q, 5)
    assert retrieval.candidates(index, 3, 3).count() == 1600  # 800,000 pairs share the common term
    assert {tuple(r) for r in retrieval.top_matches(q, d, 3, 3, 5).select("query_id", "doc_id", "score").collect()} == {(k, 4 * k + j, 4) for k in range(400) for j in range(3)}


def test_snippets(spark):
    rows = spark.createDataFrame([("aa  bb\n\ncc dd Ee", ["ee", "cc"]), ("none here", ["zz"]), (None, ["a"]), ("x", [])], "text string, terms array<string>")
    assert [r[0] for r in rows.select(retrieval.snippet("text", "terms", 3, 5)).collect()] == ["bb cc", "none ", None, "x"]


@pytest.mark.parametrize("shard", [2, 200_000])
def test_names(spark, shard, monkeypatch):
    monkeypatch.setattr(aliases, "SHARD_ALIASES", shard)
    table = spark.createDataFrame([(1, "Civil Code", "civil"), (2, "civil", "civil"), (3, "act", "act"), (4, "contract act", "contract"), (5, None, "none"), (6, " ", "blank"), (7, "x", "x"), (8, "y", "y"), (9, "z", "z")], "ord int, alias string, canonical string")
    docs = [(1, "the CIVIL\ncode", "a"), (2, "Contract  Act z y x civil", "a"), (3, "nothing", "a"), (4, None, "b"), (5, "act", None), (6, "contr", "b")]
    fallback = F.when(F.col("lang") == "a", F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("r")))
    got = {r.doc_id: r.names for r in aliases.entities(spark.createDataFrame(docs, "doc_id long, text string, lang string"), table, "lang", fallback, cap=4).collect()}
    assert got == {1: ["civil"], 2: ["civil", "act", "contract", "x"], 3: ["p", "q"], 4: ["r"], 5: ["act"], 6: ["r"]}


def test_equal_loads_follow_the_heap():
    # by hand, three ranks: 5, 4, 4 fill them in turn; the second 4 stands left below the root once the first two have sunk
    assert multipack.spread([5, 4, 4], 3) == ([0, 2, 1], 5)
    # loads 0,0,0 -> add 3 to rank 0, which sinks left: [r1 0, r0 3, r2 0]; add 3 to r1, which sinks right below r2: [r2 0, r0 3, r1 3];
    # add 3 to r2: nothing below is smaller, so it stays the root and takes the next one too
    assert multipack.spread([3, 3, 3, 3], 3)[0] == [2, 2, 1, 0]


def test_tensors_of_the_packers_batches(spark):
    rng = random.Random(6)
    samples = [(k, [rng.randrange(9) + 1 for _ in range(rng.randint(1, 6))], [rng.randrange(90) + 100 for _ in range(rng.randint(1, 9))]) for k in range(90)]
    frame = spark.createDataFrame(samples, "sample_id long, inst array<int>, resp array<int>")
    lengths = frame.select("sample_id", (F.size("inst") + F.size("resp") - 1).alias("length"))
    packed = multipack.pack(lengths, 40, 2, 3)
    by = {}
    for r in packed.collect():
        by.setdefault((r.shard, r.batch, r["rank"]), []).append((r.slot, r.sample_id))
    assert len({i for x in by.values() for _, i in x}) == sum(map(len, by.values())) >= 90 - 2
    for target_only in (True, False):
        rows = tensors.batch_tensors(packed, frame, 40, target_only).collect()
        assert len(rows) == len(by)
        for r in rows:
            own = [samples[i] for _, i in sorted(by[r.shard, r.batch, r["rank"]])]
            sizes = [len(i) + len(o) - 1 for _, i, o in own]
            assert sizes == sorted(sizes, reverse=True) and sum(sizes) <= 40
            inputs = [x for _, i, o in own for x in i + o[:-1]]
            labels = [x for _, i, o in own for x in ([-100] * (len(i) - 1) if target_only else i[1:]) + o]
            assert r.inputs == inputs + [0] * (40 - len(inputs)) and r.labels == labels + [-100] * (40 - len(labels))
            assert r.position_ids == [x for n in sizes for x in range(n)] + [0] * (40 - len(inputs))
            assert r.cu_seqlens[: len(sizes) + 1] == [sum(sizes[:k]) for k in range(len(sizes) + 1)] and len(r.cu_seqlens) == 40
            assert (r.total_seqlen, r.numseqs, r.max_seqlen_all) == (sum(sizes), len(sizes), max(sizes))
            assert (r.max_seqlen_prefix, r.max_seqlen_causal) == (max(len(i) for _, i, _ in own), max(len(o) for _, _, o in own) - 1)
