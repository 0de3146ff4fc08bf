"""As-of versions and acceptance in rounds against brute force."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.accept import accepted
from sparkloom.operators.asof import asof_join, with_pinned
from sparkloom.operators.similar import best_ratio

DAY = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize(("keys", "ranges"), [(9, 5), (1, 7), (60, 3)])
def test_asof(spark, keys, ranges):
    rng = random.Random(keys)
    key, day = lambda: rng.choice([*range(keys), None] if rng.random() < 0.2 else range(keys)), lambda: rng.choice((None, *(DAY + dt.timedelta(days=rng.randrange(40)) for _ in range(9))))
    versions = [(key(), day(), n, f"v{n}") for n in range(200)]
    asks = [(key(), day(), n) for n in range(250)] + [(0, DAY, 900)] * 2
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    a = spark.createDataFrame(asks, "k0 long, as_of timestamp, ask_id long").repartition(3)
    v = spark.createDataFrame(versions, "k0 long, begins timestamp, revision long, body string").repartition(2)
    got = sorted((r.ask_id, r.version.revision if r.version else None) for r in asof_join(a, v, "k0", "as_of", "begins", "revision").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for k, t, n in asks:
        fit = [(b, r) for vk, b, r, _ in versions if None not in (k, t, b) and vk == k and b <= t]
        want.append((n, max(fit)[1] if fit else None))
    assert got == sorted(want)


def test_without_versions_or_asks_and_pinned(spark):
    a = spark.createDataFrame([(1, DAY), (2, DAY), (3, DAY), (4, DAY)], "k long, t timestamp")
    none = spark.createDataFrame([], "k long, b timestamp, status string")
    found = asof_join(a, none, "k", "t", "b", "status")
    assert [r.version for r in found.collect()] == [None] * 4 and asof_join(a.limit(0), none, "k", "t", "b", "status").count() == 0
    later = DAY + dt.timedelta(days=1)
    pinned = spark.createDataFrame([(1, DAY, "in force"), (2, DAY, "gone"), (3, later, "in force")], "k long, b timestamp, status string")
    got = {r.k: (r.version is not None, r.is_pinned) for r in with_pinned(found, pinned, "k", "t", "b", "status", "in force").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)}


def test_accepted_in_rounds(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(("statute", "liberty", "contract", "property", "evidence", "procedure", "judgment", "obligation")) + str(rng.randrange(4)) for _ in range(14))
    held = [(k, text()) for k in range(5)]
    pool = [text() for _ in range(30)]
    rows, place = [], {}
    for n in range(160):
        g = rng.choice("abc")
        t = rng.choice((rng.choice(pool), rng.choice(held)[1], text(), None))
        rows.append((n, g, t, place.setdefault(g, 0)))
        place[g] += 1
    quotas = {"a": 9, "b": 100, "d": 3}
    c = spark.createDataFrame(rows, "candidate_id long, grp string, text string, place long")
    h = spark.createDataFrame(held, "item_id long, text string")
    similar = {r.doc_id: r.similarity for r in best_ratio(c.select(F.col("candidate_id").alias("doc_id"), "text"), h).collect()}
    want, seen, have = set(), set(), dict.fromkeys(quotas, 0)
    for n, g, t, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if g in quotas and similar.get(n, 0) < 0.8 and (g, t) not in seen and have[g] < quotas[g]:
            have[g] += 1
            seen.add((g, t))
            want.add(n)
    got = accepted(c, h, spark.createDataFrame(list(quotas.items()), "grp string, quota int"), 0.8, first=1)
    assert {r.candidate_id for r in got.collect()} == want and have["a"] == 9 and 0 < have["b"] < 100
    assert all(difflib.SequenceMatcher(None, rows[n][2] or "", t).ratio() < 0.999 for n in want for _, t in held)
