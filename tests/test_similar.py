"""Best ratios against all pairs of whole texts."""

import random
import re

from sparkloom.operators.similar import best_ratio


def test_whole_texts_are_tested(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    items = [(k, text(40)) for k in range(6)] + [(6, "short one"), (7, text(400))]
    docs = [(k, text(300) + " " + items[k][1] + " " + text(100 * k)) for k in range(6)]
    docs += [(10, "sh①ort\n one"), (11, re.sub(" ", "  \n", items[1][1])), (12, items[7][1][1500:2000]), (13, text(200)), (14, None), (15, "")]
    got = {r.doc_id: (r.item_id, r.similarity) for r in best_ratio(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = lambda x: re.sub("[①-⑩]", "", re.sub(r"\s+", "", x or ""))
    want = {}
    for i, x in docs:
        for j, y in items:
            a, b = norm(x), norm(y)
            if a and b and (a == b or (len(a) > 120 and a[:120] in b) or (len(b) > 120 and b[:120] in a)):
                want.setdefault(i, (j, 1.0))
    assert set(want) == {0, 1, 2, 3, 4, 5, 10, 11, 12}
    assert {i: m for i, m in got.items() if m[1] == 1.0} == want
