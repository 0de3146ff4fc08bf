import random

from sparkloom.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_components_equal_union_find(spark):
    draw = random.Random(3)
    chain = [(k, k + 1) for k in range(40)]
    draw.shuffle(chain)
    cases = {
        "random": [(draw.randrange(60), draw.randrange(60)) for _ in range(45)],
        "chain": chain,
        "two parents": [(5, 1), (5, 2), (9, 2)],
        "stars and loops": [(0, 7), (0, 8), (3, 3), (7, 0), (0, 7)],
        "empty": [],
    }
    for name, edges in cases.items():
        got = components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len(got) == len({x.node for x in got}), name
        assert {x.node: x.root for x in got} == brute(edges), name
