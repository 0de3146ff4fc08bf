"""Divergence, importance resampling and licence scans against brute force, on rows with nulls, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sparkloom.llm import divergence, licenses, resample

SCHEMA = "doc_id long, text string, lang string, source string, term string, gid long, block int, weight int, rank int, words string, value int"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 1, 2, 3, "y", 4) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] + ["É", "ÀB", "日本", "The", "x9"]
    out = []
    for k in range(220):
        text = " ".join(rng.choice(words[: rng.choice((5, 30, 65))]) for _ in range(rng.choice((0, 1, 8, 30, 60))))
        out.append((k, text, rng.choice(("en", "en", "en", "de", None)), rng.choice(("a", "b", "b", "c", None, "é"))))
    out += [(None, None, None, None), (7, "wa-wb WA", "en", "a"), (7, "wa-wb WA", "en", "a"), (500, "the " * 3000, "fr", "only"), (501, "", "xx", "p"), (502, "9 9 !", "xx", "q")]
    return out


def wanted_divergence(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        every = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(p)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("limits", [(32_000_000, 50_000, 2_000_000, 1_000_000), (400, 7, 5, 3)])
def test_divergence(spark, rows, limits, monkeypatch):
    for name, value in zip(("BLOCK_BYTES", "SCAN_ROWS", "PAIR_ROWS", "HELD_PAIRS"), limits, strict=True):
        monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.divergence(table(spark, rows), least=10, top=4).collect()]
    want = wanted_divergence(rows, 10, 4)
    assert len(got) == len(want) and set(got) == want
    assert divergence.divergence(table(spark, rows).limit(0)).count() == 0


def test_blocks_and_scans_do_not_change_counts():
    """The worker's functions, with limits of a few rows, in this process."""
    import pyarrow as pa

    block = divergence._Block()
    for raw, source in ((b"B a a", "s"), (b"a b", "s"), (b"a", "t"), (b"! 9", "t")):
        block.add(raw, "en", source)
    got = sorted(tuple(r.values()) for r in block.counted().to_pylist())
    assert got == [("en", "a", "s", 2, 3), ("en", "a", "t", 1, 1), ("en", "b", "s", 2, 2)]
    rng = random.Random(3)
    rows = sorted((lang, f"t{rng.randrange(9)}", rng.choice("abc"), rng.randrange(1, 4), rng.randrange(1, 9)) for lang in ("de", "en") for _ in range(80))
    names = ["lang", "term", "source", "docs", "n"]
    for step in (1, 3, 500):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + step]]) for k in range(0, len(rows), step)]
        kept = [tuple(r.values()) for b in divergence._keep(20)(iter(batches)) for r in b.to_pylist()]
        total, docs, own = collections.Counter(), collections.Counter(), collections.Counter()
        for lang, term, source, d, n in rows:
            total[lang, term] += n
            docs[lang, term] += d
            own[lang, term, source] += n
        assert [x[:5] for x in kept] == [(*k, n, total[k[:2]]) for k, n in sorted(own.items()) if docs[k[:2]] >= 20]
        assert sum(x[5] for x in kept) == len({x[:2] for x in kept})
        short = [r[:3] + (r[4],) for r in rows]
        pairs = [pa.RecordBatch.from_pylist([{"lang": a, "term": b, "gid": g, "p": 5 + n, "zero": 2} for g, (a, b, _, n) in enumerate(short[k : k + step], k)]) for k in range(0, len(rows), step)]
        found = {(r["a"], r["b"]): r["v"] for b in divergence._both(iter(pairs)) for r in b.to_pylist()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        value = lambda x, y: f(x, y) - f(x, 2) - f(2, y) + f(2, 2)
        assert found == {(i, j): value(5 + short[i][3], 5 + short[j][3]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if short[i][:2] == short[j][:2]}


def wanted_sample(rows, target, percent, least, longest):
    def features(text):
        words = ALNUM.findall((text or "").translate(LOWER))
        return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    here = collections.Counter(bucket(w) for r in rows for w in features(r[1])[1])
    there = collections.Counter(bucket(w) for t in target for w in features(t)[1])
    s, t = sum(here.values()), sum(there.values())
    gain = {b: math.floor(1000 * math.log((there[b] + 1) * (s + 10000) / ((here[b] + 1) * (t + 10000)))) for b in here}
    out = []
    for doc_id, text, *_ in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize(("size", "longest"), [(8_000_000, 1), (300, 1), (300, 3)])
def test_resample(spark, rows, size, longest, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BYTES", size)
    target = [" ".join(f"wa{chr(97 + k)}" for k in range(9)), None, "", "The wb x9"]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(table(spark, rows), goal, percent=30, longest=longest)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted_sample(rows, target, 30, 20, longest)


def test_resample_without_rows_or_target(spark, rows):
    goal = spark.createDataFrame([], "item_id long, text string")
    got = resample.resample(table(spark, rows), goal, percent=100, least_words=0)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted_sample(rows, [], 100, 0, 1)
    assert resample.resample(table(spark, rows).limit(0), goal).count() == 0


def plain_detections(text):
    """Every rule tried at every word, without the gate; pairs compared one by one."""
    found = set()
    for at in (k + 1 for k, x in enumerate(text) if x == " "):
        for rule in licenses.rules():
            match = re.compile(rule.pattern.pattern).match(text, at)
            if not match:
                continue
            kind, start = rule.kind, at
            if kind in ("name", "short", "id"):
                before = text[max(0, at - 96) : at]
                tag, lead = licenses._TAG.search(before), licenses._LEAD.search(before)
                if tag or lead:
                    kind, start = ("tag", at - len(tag[0]) + 1) if tag else ("notice", at - len(lead[0]) + 1)
                elif kind == "id":
                    continue
            found.add((licenses.KINDS[kind][0], kind, start, match.end(), rule.label))
    rank = lambda x: (-x[0], x[2], -x[3], x[4])
    order = sorted(found, key=rank)
    return {x for k, x in enumerate(order) if not any(y[2] <= x[2] and y[3] >= x[3] for y in order[:k])}, found


LICENSE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published, version 3 or later.",
    "Released under the MIT License. All Rights Reserved! all rights\nreserved", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later",
    "CC BY-NC 4.0 and CC-BY and cc by sa 3.0", "the general public licenses, the General PUBLIC License", "she met him at MIT on a permit", "cc byé éall rights reserved",
    None, "", "...", "CC BY", "x " * 2000 + "cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "Copyright (c) 2021. No part of this publication may be reproduced. Tous droits réservés.", "dual licensed under the BSD 3-Clause license or LGPL v2.1", "in the public domain, released into the public domain",
]


def test_license_scan(spark):
    rows = [(k if k != 3 else None, t, "en", "s") for k, t in enumerate(LICENSE_TEXTS)] * 2
    got = sorted(map(tuple, licenses.license_scan(table(spark, rows)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        remain, found = plain_detections(" " + " ".join(words) + " ") if words else (set(), set())
        base = {x for _, x in places}
        labels = base | {x[4] for x in remain if x[1] != "phrase"}
        score = max([0.0] + [licenses.KINDS[x[1]][1] for x in remain | {y for y in found if y[1] == "phrase"}])
        starts = [k for k, _ in places]
        want.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    assert got == sorted(want, key=repr)
    assert licenses.license_scan(table(spark, rows).limit(0)).count() == 0


def test_which_license_remains():
    left = lambda text: [x[0] for x in licenses.scan(text.encode())[2]]
    assert left(LICENSE_TEXTS[0]) == ["apache-2.0", "apache-2.0"]
    assert left("GNU General Public License, version 3") == ["gpl-3.0"]
    assert left("GNU General Public License, version 2 or any later version") == ["gpl-2.0-or-later"]
    assert left("SPDX-License-Identifier: MIT") == ["mit"] and left("he studied at MIT") == []
    assert left("Creative Commons Attribution-NonCommercial 4.0") == ["cc-by-nc"]
    assert len(licenses.rules()) > 200 and all(re.match(re.escape(r.literal), r.pattern.pattern) for r in licenses.rules())


def test_many_detections_are_resolved_without_pairs():
    found = [licenses.Detection("a", "name", k, k + 5) for k in range(0, 400_000, 4)] + [licenses.Detection("b", "text", 0, 200_000)]
    assert len(licenses.resolved(found)) == 1 + sum(d.stop > 200_000 for d in found[:-1])
