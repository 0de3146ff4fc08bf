"""Repeated ids, batches, warm caches and whole contracts, against the libraries themselves or brute force."""

import hashlib
import tracemalloc
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from sparkloom.llm import counts, exact, induced, pieces, toxicity, vectors

SCHEMA = "doc_id long, text string, digest string, batch string, query_row long, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "b", 1, 2) for r in rows], SCHEMA)


def test_queries_that_repeat_an_id_keep_their_own_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    ids = [0, 0, 100, 100, 100, *range(1, 56)]
    rows = [(i, v.tolist(), 1, 2, 3) for i, v in zip(ids, x, strict=True)]
    got = vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, chunk int, query_row int"), k=4).collect()
    want = []
    for i, v in zip(ids, x, strict=True):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in zip(ids, x, strict=True) if j != i)[:4]
            want += [(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_few_or_no_candidates(spark):
    kind = "vec_id long, embedding array<double>"
    assert vectors.search(spark.createDataFrame([], kind)).count() == 0
    assert vectors.search(spark.createDataFrame([(0, [1.0, 2.0])], kind)).count() == 0
    got = vectors.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])], kind)).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2)]


def test_batches_against_one_index(spark):
    name = f"digests_{uuid.uuid4().hex}"
    kept = lambda rows: sorted((r.doc_id or -1, r.keep_id, r.kept) for r in exact.exact_dedup(table(spark, rows), name).collect())
    assert kept([(1, "x"), (2, "y"), (2, "y"), (None, None)]) == [(-1, None, True), (1, 1, True), (2, 2, False), (2, 2, True)]
    assert kept([(1, "x"), (9, "y"), (3, "z"), (4, "")]) == [(1, 1, False), (3, 3, True), (4, None, False), (9, 2, False)]
    assert kept([(1, "x"), (3, "z"), (8, "new")]) == [(1, 1, False), (3, 3, False), (8, 8, True)]
    assert exact.DigestIndex(spark, name, 10**9).buckets == exact.BUCKETS  # as the table was made
    spark.sql(f"DROP TABLE {name}")


def test_large_batches_make_more_buckets(spark):
    name = f"digests_{uuid.uuid4().hex}"
    assert exact.DigestIndex(spark, name, 50_000_000).buckets == 25 == exact.DigestIndex(spark, name).buckets
    spark.sql(f"DROP TABLE {name}")


def test_a_warm_cache_counts_alike_and_takes_only_misses(spark, tmp_path):
    path, model = str(tmp_path / "counts"), P.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(model)
    want = lambda rows: sorted(((i, len((t or "").encode()), len(coder.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    got = lambda rows: sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counts.token_counts(table(spark, rows), model, path).collect()), key=repr)
    first = [(1, "one two"), (2, None), (3, "one two"), (None, "é 日本")]
    assert got(first) == want(first)
    again = [*first, (4, "more words here"), (4, "more words here"), (5, "")]
    assert got(again) == want(again)
    rows = counts.CountCache(spark, path).read(counts.tokenizer_digest(model))
    assert rows.count() == rows.select("digest").distinct().count() == 4


def test_pieces_hold_the_librarys_ids(spark):
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "Hello  world, naïve façade"), (2, None), (3, ""), (4, " lead and tail "), (5, "日本語 \x00 tab\t\n"), (6, "word " * 900), (7, "▁mark <s> </s>")]
    for r in pieces.encode_documents(table(spark, rows), path).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode(text)
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.round_trip == (r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest())
        assert r.parity


def test_a_repeated_id_is_learnt_from_in_one_way(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = table(spark, [(1, "b"), (1, "a"), (1, None), (2, "x"), (2, "w"), (3, "y"), (4, "z")])
    rows = {r.doc_id: (r.text, r.toxic) for r in toxicity.training_rows(docs, labels).collect()}
    held = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert rows == {i: x for i, x in {1: ("", 1), 2: ("w", 0)}.items() if i not in held}


def test_ids_sources_and_languages_do_not_enter_scores(spark):
    texts = [f"you are a kind person number {k}" if k % 2 else f"you are an idiot, shut up number {k}" for k in range(300)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, list(enumerate(texts))), labels)
    other = spark.createDataFrame([(k + 10_000, t, "zz", f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    a = {r.doc_id: r.score for r in toxicity.score(table(spark, list(enumerate(texts))), model).collect()}
    b = {r.doc_id - 10_000: r.score for r in toxicity.score(other, model).collect()}
    assert a == b and min(a[k] for k in range(0, 300, 2)) > max(a[k] for k in range(1, 300, 2))


def test_counts_and_base_of_the_scores(spark):
    import collections
    import math
    import re

    from sparkloom.llm import contexts

    rows = [(k, t) for k, t in enumerate(["The cat sat.", "the CAT sat", None, "", "a\tb\n\na", "É é the", "x" * 50, "the the the the", "sat on É"])] + [(None, "the cat"), (3, "the dog"), (3, "the dog")]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        want.append((i, held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(base, 9)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in contexts.log_scores(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_the_pipeline_takes_what_was_planted_and_nothing_else(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(n))
    clean = {k: text(150) for k in range(40)}
    near = clean[7].split(" ")
    near[75] = "changed"
    passage = text(70)
    bad = {200 + k: f"you stupid idiot, shut up you worthless moron {text(20)}" for k in range(30)}
    docs = clean | bad | {300: clean[3], 301: clean[3], 302: " ".join(near), 303: text(100) + " " + passage + " " + text(100), 304: text(90) + " " + passage}
    labels = [(k, int(k in bad)) for k in [*clean, *bad]]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stay = (set(clean) - {3}) | {301, 303, 304}  # of equal texts the last, of near ones the first
    assert {r.doc_id for r in out} == stay
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = lambda t: len(coder.encode(t, add_special_tokens=False).ids) + 1
    sums = dict.fromkeys(stay, 0)
    for r in out:
        sums[r.doc_id] += r.length
    assert all(sums[k] == size(docs[k]) for k in stay - {303, 304})
    for k in (303, 304):
        left = docs[k].replace(passage, "")
        assert size(left) - 3 <= sums[k] <= size(left) + 3  # a space beside the passage goes too


def test_packing_looks_ahead_within_bounds(spark):
    import random

    from sparkloom.llm import packing

    rng = random.Random(3)
    rows = [(k if k % 50 else None, 0, 0, rng.choice((rng.randint(1, 64), rng.randint(1, 64), 64)), 0) for k in range(3000)]
    frame = spark.createDataFrame(rows, packing.PIECES)
    for open_bins, window, groups in ((512, 1024, 16_384), (8, 16, 500), (1, 1, 100)):
        got = packing.pack(frame, 64, open_bins, groups, window).collect()
        assert sorted((r.doc_id or -1, r.length) for r in got) == sorted((r[0] or -1, r[3]) for r in rows)
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 64
        if open_bins == 512:
            assert len(places) <= 1.01 * sum(r[3] for r in rows) / 64 + 1


def test_windows_keep_groups_apart():
    import pyarrow as pa

    from sparkloom.llm.packing import windows

    batches = [pa.RecordBatch.from_pydict({"_group": g, "x": list(range(len(g)))}) for g in ([1, 1, 1], [1, 1, 2], [2, 3, 3, 3, 3], [3])]
    assert [b.column("_group").to_pylist() for b in windows(iter(batches), 3)] == [[1, 1, 1], [1, 1], [2, 2], [3, 3, 3], [3, 3]]


def test_memory_of_suffix_order():
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    strings = [b" ".join(words[k] for k in rng.integers(0, len(words), 110)) for _ in range(600)]
    size = sum(map(len, strings))
    tracemalloc.start()
    induced.repeated_windows(strings, 250)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * size


def test_answers_of_contexts_are_dealt_once(spark):
    from sparkloom.llm import contexts

    scores = contexts.log_scores(table(spark, [(1, "a b"), (2, "b c"), (None, None)]))
    # what comes back is gathered and joined by one exchange, without a staged copy of the gathered answers between
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "lm-answers" in scores._jdf.queryExecution().executedPlan().toString()
