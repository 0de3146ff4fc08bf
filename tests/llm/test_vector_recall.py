"""Recall of the vector search where lists far outnumber the least number of probes."""

import numpy as np

from sparkloom.llm import vectors


def test_recall_with_many_lists(spark):
    x = np.random.default_rng(4).normal(size=(30_000, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in vectors.search(rows, query_every=300).collect()}
    want = set()
    for q in range(0, len(x), 300):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want |= {(q, int(v)) for v in np.argsort(d, kind="stable")[:10]}
    recall = len(got & want) / len(want)
    print("recall", recall)
    assert recall >= 0.95
