"""Sums and places within groups on tables with null groups, null ids, and sparse or clustered ids."""

import random

import duckdb
import pytest

from sparkloom import queries
from sparkloom.plans.dialects import ranges
from sparkloom.sources.trees import write_capped_jsonl

NAMES = "doc_byte_budget_prefix doc_token_budget_prefix prepare_offsets byte_cap_first_row byte_capped_corpus epoch_permutation quota_per_group v1_index v1_merge token_target_stop budget_mix written_lengths".split()


def ids(kind, rng):
    if kind == "hashed":
        return [rng.randrange(-(2**63), 2**63) for _ in range(180)]
    if kind == "clustered":
        return list(range(100)) + [10**15 + k for k in range(79)] + [2**62]
    return [*range(90), *range(1000, 1090)]


@pytest.fixture(params=["dense", "hashed", "clustered"])
def place(request, spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 90))) + "\nmore text", rng.choice(("en", "de", None)), rng.choice(("a", "b", None))) for i in ids(request.param, rng)]
    rows += [(None, "no id here at all, only text", "en", "a"), (None, "none here either, only text", "de", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_null_groups_and_sparse_ids_stay(spark, place, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}/documents.parquet/*.parquet'")
    there = con.execute(queries.ORACLES[name])
    names = [x[0] for x in there.description]
    plain = lambda rows: sorted(repr([float(v) if isinstance(v, int | float) else v for v in r]) for r in rows)
    assert plain(queries.QUERIES[name](spark, place).select(*names).collect()) == plain(there.fetchall())


def test_every_row_gets_an_offset(spark, place):
    assert queries.QUERIES["prepare_offsets"](spark, place).count() == 182
    rows = spark.read.parquet(f"{place}/documents.parquet")
    found = spark.sql(f"SELECT bk, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM ({ranges('doc_id', '{d}', 4).over('SELECT * FROM {d}')}) t GROUP BY bk ORDER BY bk", d=rows).collect()
    assert found[0].bk == -1 and found[0].n == 2 and len(found) <= 17
    assert all(a.high < b.low for a, b in zip(found[1:], found[2:], strict=False)) and max(r.n for r in found) <= 24


def test_capped_lines_with_null_and_text_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x"), ("b", "y"), ("a", "z"), ("a", "a"), ("c", "far too long" * 9)], "k string, v string").repartition(3)
    write_capped_jsonl(rows, str(tmp_path / "o"), "k", 90)
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines == ['{"v":"x"}', '{"k":"a","v":"a"}', '{"k":"a","v":"z"}', '{"k":"b","v":"y"}']
