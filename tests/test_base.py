"""Queries against DuckDB, and properties of chunking and packing."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom import queries
from sparkloom.operators.chunking import cut
from sparkloom.operators.multipack import batches, spread
from sparkloom.operators.similar import ratio

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, duck, name):
    rows = queries.QUERIES[name](spark, SF)
    there = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in there.description]
    assert sorted(rows.columns) == sorted(names)
    mine = sorted(repr([plain(v) for v in r]) for r in rows.select(*sorted(names)).collect())
    order = [names.index(n) for n in sorted(names)]
    assert mine == sorted(repr([plain(r[k]) for k in order]) for r in there.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n#", max_size=400), st.integers(20, 80))
def test_chunks_cover_the_text(text, most):
    pieces = cut(text, most, 5, ("\n#", "\n\n"), 0.55)
    assert all(0 < len(p) <= most for p in pieces)
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_batches_fit(lengths):
    for a, b, place in batches(lengths, 20, 3):
        for r in range(3):
            assert sum(n for n, p in zip(lengths[a:b], place) if p == r) <= 20


def test_longest_first():
    assert spread([7, 5, 4, 3, 1], 2)[1] == 10


def test_ratio_shortcut():
    assert ratio("x" * 200 + "tail", "x" * 130) == 1.0
    assert ratio("abc", "xyz") == 0.0
