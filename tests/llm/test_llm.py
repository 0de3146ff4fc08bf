"""Operators against brute force, on small tables with nulls, empties, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import contexts, counts, exact, induced, near, packing, pieces, repair, repeats, toxicity, trees, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, piece int, length long, n int, key string"
BYTE = P.path("byte_bpe_50k.json")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(400), text(200)
    parts = base.split(" ")
    near_copy = " ".join("changed" if k in (50, 300) else w for k, w in enumerate(parts))
    out = [(1, base), (2, near_copy), (3, base), (4, None), (5, ""), (6, text(90) + " " + passage + " " + text(80)), (7, passage + " " + text(30))]
    out += [(8, "ab " * 400), (9, "  two  spaces\n\n\tand <|endoftext|> é日本 "), (10, text(9000)), (None, "no id"), (11, "short"), (11, "short"), (12, "SHORT")]
    return out + [(20 + k, text(60)) for k in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, BYTE).collect()
    want = collections.Counter()
    for i, t in rows:
        ids, at = ids_of(t), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 2048)):
            want[(i, k, at, n, crc(ids[at : at + n]))] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_fullest_bin_closes():
    packer = packing.BestFit(10, 2)
    assert [packer.put(n)[0] for n in (7, 6, 5, 4, 4)] == [0, 1, 2, 1, 2]


def test_token_files(docs, rows, empty):
    got = repair.token_files(docs, BYTE).orderBy("start").collect()
    want = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = ids_of(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert repair.token_files(empty, BYTE).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 200)
    ids = rng.integers(0, 6, sizes.sum()).astype(np.uint32)
    block = repair.Block(repair.write_block(np.arange(200), ids, sizes, 1000))
    ends = np.cumsum(sizes)
    assert len(block.rules) and (block.all() == ids).all()
    for k in range(200):
        own = ids[ends[k] - sizes[k] : ends[k]]
        assert (block.document(k) == own).all()
        a, b = sorted(rng.integers(0, sizes[k] + 1, 2).tolist())
        assert (block.span(k, a, b) == own[a:b]).all()


def test_exact(docs, rows, empty, spark):
    got = exact.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == collections.Counter(dict.fromkeys(by, 1))
    for r in got:
        g = by[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((x for x in g if x is not None), default=None)
    assert exact.exact_dedup(empty).count() == 0
    assert exact.kept_rows(docs).columns == docs.columns


def test_index_persists(spark):
    name = "index_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    a = exact.exact_dedup(table(spark, [(1, "x"), (2, "y")]), name).collect()
    b = exact.exact_dedup(table(spark, [(3, "x"), (4, "z")]), name).collect()
    assert all(r.kept for r in a) and {r.doc_id: r.kept for r in b} == {3: False, 4: True}


def test_counts(docs, rows, empty):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.token_counts(docs, P.path("word_bpe_49k.json")).collect())
    want = collections.Counter()
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert counts.token_counts(empty, P.path("word_bpe_49k.json")).count() == 0


def test_pieces(docs, rows, empty):
    got = pieces.encode_documents(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    assert pieces.encode_documents(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    for _ in range(120):
        x = rng.integers(1, rng.integers(2, 6), rng.integers(1, 90))
        t = np.append(np.tile(x, 3)[:100], 0)
        order, lcp = induced.suffix_order(t, 10**6)
        t = t.tolist()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for a, b, n in zip(order, order[1:], lcp[1:]):
            assert t[a : a + n] == t[b : b + n] and t[a + n : a + n + 1] != t[b + n : b + n + 1]


def test_repeats(docs, rows, empty):
    data = [(t or "").encode() for _, t in rows]
    windows = collections.Counter(b[k : k + 400] for b in data for k in range(len(b) - 399))
    want = collections.Counter()
    for (i, _), b in zip(rows, data):
        mask = bytearray(len(b))
        for k in range(len(b) - 399):
            if windows[b[k : k + 400]] > 1:
                mask[k : k + 400] = b"\1" * 400
        kept = bytes(v for v, m in zip(b, mask) if not m)
        want[(i, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(map(tuple, repeats.removal(docs).collect())) == want
    assert repeats.removal(empty).count() == 0
    assert repeats.without_repeats(docs).columns == docs.columns


def test_near(docs, rows, empty):
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    own = {r.doc_id: r.class_id for r in got}
    assert own[1] == own[2] == own[3] == 1 and own[4] == own[5] == 4 and own[11] == own[12] == 11
    assert len(set(own.values())) == len({k for k in own if k not in (2, 3, 5, 12)})
    assert near.near_duplicates(empty).count() == 0


def test_samples_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = np.sort(pool[:900]), np.sort(pool[100:1000])
    hits = total = 0
    for k in range(40):
        shift = np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 63) - 1)
        x, y = np.sort(a ^ shift), np.sort(b ^ shift)
        s = near.samples(np.concatenate([x, y]), np.full(1800, 64.0), np.array([900, 900]))
        hits, total = hits + (s[0] == s[1]).sum(), total + near.HASHES
    assert abs(hits / total - 0.8) < 0.05


def test_context_trees(docs, rows, empty):
    got = contexts.log_scores(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    texts = {k: contexts.canonical(t or "")[0] for k, (_, t) in enumerate(rows)}
    nodes = collections.defaultdict(lambda: [0, 0])
    D = contexts.DEPTH

    def walk(data, at):
        past = (b"\0" * D + data[:at])[-D:]
        for k in range(8):
            yield [(past[D - d :], (1 << k) | (data[at] >> (8 - k))) for d in range(D + 1)], data[at] >> (7 - k) & 1

    for k, (i, _) in enumerate(rows):
        if not held(i) and len(texts[k]) < 5000:
            pass
        if not held(i):
            for at in range(len(texts[k])):
                for path, bit in walk(texts[k], at):
                    for node in path:
                        nodes[node][bit] += 1
    kids = collections.defaultdict(list)
    for past, node in nodes:
        if past:
            kids[(past[1:], node)].append((past, node))
    lw = {}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    for node in sorted(nodes, key=lambda x: -len(x[0])):
        e = kt(*nodes[node])
        lw[node] = e if len(node[0]) == D else np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(lw[c] for c in kids[node]))
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, (i, _) in enumerate(rows):
        if len(texts[k]) > 600:
            continue
        total = 0.0
        for at in range(len(texts[k])):
            for path, bit in walk(texts[k], at):
                p = None
                for node in reversed(path):
                    a, b = nodes.get(node, (0, 0))
                    own = (b + 0.5) / (a + b + 1)
                    w = math.exp(math.log(0.5) + kt(a, b) - lw.get(node, 0.0))
                    p = own if p is None else w * own + (1 - w) * p
                total += math.log10(p if bit else 1 - p)
        assert any(abs(r.score - total) < 1e-3 * max(1, abs(total)) for r in by[i]), (i, total, by[i])
    assert contexts.log_scores(empty).count() == 0


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = trees.BoostedTrees(rounds=40).fit(x[:1500], y[:1500])
    assert ((model.decision(x[1500:]) > 0) == (y[1500:] == 1)).mean() > 0.95
    at, value = trees.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], at, value).tolist() == [0, 0.5, 0.5, 1]


def test_toxicity(spark, empty, docs):
    base = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.toxicity(real, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(float)
    x[10:40] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [None] * 16), (9300, [float("nan")] * 16), (9400, [1.0])]
    got = vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = 0
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 100))
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert all(abs(d[v] - s) < 1e-9 for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
    assert hits / (10 * len(by)) >= 0.9


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id"} <= set(out.columns)
