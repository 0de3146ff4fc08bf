"""Links within bands, and whole classes, against all pairs."""

import collections
import math
import random

import numpy as np

from sparkloom.llm import near


def payload(own, idf=128):
    h = np.sort(np.array(sorted(own), "<u4"))
    return h.tobytes(), np.array([idf], "<u2").tobytes(), np.array([1], "<u4").tobytes()


def roots(names, edges):
    root = {x: x for x in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in names}


def alike(x, y):
    a, _, u = near.shingle_weights(*x)
    b, _, v = near.shingle_weights(*y)
    return near.similarity(a, u, b, v)


def hold(spark, bands, **how):
    """links() joins the texts of each band as all its pairs do; bands are lists of sets of shingles."""
    keys, loads = [], {}
    for key, sets in enumerate(bands):
        for own in sets:
            uid = int(near.mix64(np.array([len(loads) + 1], np.uint64)).view(np.int64)[0])
            loads[uid] = payload(own, 100)
            keys.append((key, uid, 100 * len(own), 100 * len(own), [key]))
    want = []
    for key in range(len(bands)):
        own = [t for k, t, *_ in keys if k == key]
        want += [(a, b) for i, a in enumerate(own) for b in own[:i] if alike(loads[a], loads[b]) >= near.SIMILARITY]
    table = spark.createDataFrame([(uid, *x) for uid, x in loads.items()], "uid long, h binary, q binary, t binary")
    found = near.links(spark.createDataFrame(keys, "key long, uid long, total long, shared long, keys array<long>"), table, **how)
    got = [(r.node, r.root) for r in found.collect()]
    assert roots(loads, got) == roots(loads, want)


def test_chains(spark):
    # texts of a chain are windows over a row of shingles, so that only neighbours are similar enough
    bands = []
    for k in range(1):
        base = np.random.default_rng(k).integers(0, 1 << 32, 3000)
        bands.append([set(base[at : at + 100].tolist()) for at in range(0, 250, 10)])
    hold(spark, bands)


def test_shared_passage(spark):
    # dissimilar texts that hold one passage; some have near copies
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 1 << 32, 40).tolist()
    sets = [set(passage + rng.integers(0, 1 << 32, 40).tolist()) for _ in range(60)]
    for k in range(0, 60, 20):
        own = sorted(sets[k])
        sets += [set(own[i + 1 :] + own[:i]) for i in range(3)]
    hold(spark, [sets], split_at=2)


def test_near_misses_are_told_apart_by_parts(spark, monkeypatch):
    """Texts that were edited in different places, and so are never alike, are hardly verified against each other."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 1 << 32, 150, np.uint64))
    loads, keys = {}, []
    for uid in range(1, 121):
        gone = rng.choice(30, 2 if uid > 4 else 1, replace=False)  # runs of five shingles
        own = np.setdiff1d(base, np.concatenate([base[5 * g : 5 * g + 5] for g in gone]))
        new = rng.integers(0, 1 << 32, 5 * len(gone), np.uint64)
        h = np.sort(np.concatenate([own, new])).astype("<u4")
        q = np.where(np.isin(h, new), 128, 84).astype("<u2")
        loads[uid] = (h.tobytes(), near.pack_array(q), np.array([1], "<u4").tobytes())
        keys.append((7, uid, int(q.sum()), int(q[q < 128].sum()), [7]))
    made = []
    verify = near.verify
    monkeypatch.setattr(near, "verify", lambda *x: made.append(x[0].count()) or verify(*x))
    table = spark.createDataFrame([(uid, *x) for uid, x in loads.items()], "uid long, h binary, q binary, t binary")
    found = near.links(spark.createDataFrame(keys, "key long, uid long, total long, shared long, keys array<long>"), table)
    want = [(a, b) for a in loads for b in range(1, a) if alike(loads[a], loads[b]) >= near.SIMILARITY]
    assert roots(loads, [(r.node, r.root) for r in found.collect()]) == roots(loads, want)
    # 7,140 pairs in all, of which 6,670 are between texts of two edits
    assert want and sum(made) < 2000, made


def test_totals_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    for n, kinds in ((0, 1), (1, 1), (9, 2), (1_500_000, 600_000)):
        keys = near.mix64(rng.integers(0, kinds, n).astype(np.uint64))
        counts = rng.integers(1, 9, n).astype("<u4")
        names, back = np.unique(keys, return_inverse=True)
        want = np.bincount(back, counts, len(names))[back].astype(np.int64).tolist() if n else []
        tracemalloc.start()
        got = near.totals_in_place(keys, counts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.tolist() == want
    assert most < 30 * n  # keys and counts not counted


def weighted_classes(rows):
    """class_id by doc_id from the weighted Jaccard similarity of all pairs of texts."""
    bags = {}
    for _, text in rows:
        words = (text or "").lower().split()
        bags[text or ""] = collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter()
    df = collections.Counter(x for _, text in rows for x in bags[text or ""])
    n = len(rows)
    idf = {x: round(64 * (1 + math.log(n / c) / math.log(n))) for x, c in df.items()}
    texts = sorted(bags)
    edges = []
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = sum(idf[x] * min(c, bags[b][x]) for x, c in bags[a].items())
            total = sum(idf[x] * c for x, c in (bags[a] + bags[b]).items()) - both
            if total and both / total >= near.SIMILARITY:
                edges.append((a, b))
    root = roots(texts, edges)
    least = {}
    for doc_id, text in rows:
        least.setdefault(root[text or ""], []).append(doc_id)
    return {doc_id: min(least[root[text or ""]]) for doc_id, text in rows}


def test_classes_equal_all_pairs(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, base = [], [rng.choice(words) for _ in range(60)]
    for _ in range(60):  # a large group of near copies, a tenth of which are edited heavily
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 9])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append(" ".join(own))
    for _ in range(40):  # texts with one passage in common
        rows.append(" ".join([rng.choice(words) for _ in range(rng.choice([5, 30, 90]))] + passage))
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 40, 400]))]
        rows += [" ".join(own), " ".join(own[:-1]), "  ".join(own).upper()]
    rows += ["", None, " \n", "same text of six words here", "same text of six words here"]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == weighted_classes(rows)


def test_clashing_names_and_empty(spark):
    rows = [(1, "a b c d e f g", "x", "y", 1, 2), (2, "a b c d e f g", "x", "y", 1, 2), (3, None, "x", "y", 1, 2), (None, "no id", "x", "y", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid string, at string, uid int, n int")
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.tid, r.at) for r in got.collect()) == [(0, "x", "y"), (1, "x", "y"), (3, "x", "y")]
    assert near.one_of_each(docs.limit(0)).count() == 0
