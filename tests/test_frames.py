"""Prepared samples: lengths without ids, and ids of written samples alone, against the SQL on odd texts."""

import duckdb
import pytest

from sparkloom import queries
from sparkloom.plans import frames, stores

NAMES = "v1_index v1_merge v1_epochs written_lengths token_target_stop frame_tokens sample_policies sample_policies_direct sft_padded_rows".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("odd"))
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = [None, "", " ", "\n", "  a  b \n\n c", "x <THINK>gone\nhere</think>  kept", "<think>a</think>b<think>c</think>", "<think>open", "tab\tstays one", "é 中文\n한국 어"]
    # instructions and responses around the limits: kept, cut at even and odd room, no room at all, too long
    texts += [f"{words(i)}\n{words(r)}" for i in (1, 95, 126, 130) for r in (0, 1, 121, 122, 125, 126, 151, 152, 157)] + [words(n) for n in (126, 127, 251, 252, 253, 900)]
    rows = [(5 * k + c, x, s) for k, x in enumerate(texts) for c, s in ((1, "a"), (3, None))] + [(None, "no id", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    there = con.execute(queries.ORACLES[name])
    names = [x[0] for x in there.description]
    plain = lambda rows: sorted(repr([float(v) if isinstance(v, int | float) else v for v in r]) for r in rows)
    assert plain(queries.QUERIES[name](spark, odd).select(*names).collect()) == plain(there.fetchall())


def test_lengths_are_those_of_the_ids(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    ids = spark.sql(f"SELECT doc_id, CAST(size(inst) AS BIGINT) AS i, CAST(size(resp) AS BIGINT) AS r, fate FROM ({frames.framed(0)}) f", documents=docs)
    sizes = spark.sql(f"SELECT doc_id, inst_len AS i, resp_len AS r FROM ({frames.lengths(0)}) f", documents=docs)
    assert sorted(map(repr, map(tuple, sizes.collect()))) == sorted(repr((r.doc_id, r.i, r.r)) for r in ids.collect())
    assert {r.fate for r in ids.select("fate").distinct().collect()} == {"kept", "truncated"}


@pytest.mark.parametrize("name", ["v1_index", "v1_merge", "written_lengths", "token_target_stop"])
def test_offsets_hash_no_words(spark, odd, name):
    assert "md5(" not in queries.QUERIES[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cleaned_once_and_ids_are_made_of_written_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    text = spark.sql(frames.framed(0), documents=docs)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("(?is)<think>") == 1
    assert text.index("md5(") < text.index("Filter") and "md5(" not in text[text.index("Filter") :]


@pytest.mark.parametrize("name", ["v1_epochs", "sft_padded_rows", "written_lengths"])
def test_texts_are_framed_once_before_sums_and_places(spark, odd, name):
    assert "(?is)<think>" not in queries.QUERIES[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_told_before_texts_are_dealt(spark, odd):
    rows = stores.samples_of(spark.read.parquet(f"{odd}/documents.parquet"))
    assert "(?is)<think>" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() > 0


@pytest.mark.parametrize("name", ["frame_tokens", "sample_policies", "sample_policies_direct", "v1_index"])
def test_texts_beyond_the_counted_words_equal_sql(spark, tmp_path, name):
    # a split that stops holds CONTEXT + 4 pieces; edges of a text are empty ones
    many = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = [f"{a}{many(n)}{b}" for n in (250, 252, 253, *range(frames.CONTEXT - 1, frames.CONTEXT + 9)) for a in ("", " ") for b in ("", "\n", " \n ")]
    texts += [f"{a}<think>{many(n)}\n</think> a <b\n" for n in (90, 252, *range(frames.CONTEXT, frames.CONTEXT + 9), 400) for a in ("", "  ")]
    rows = [(23 * 19 * 17 * 5 * 2 * k + c, x, "a") for k, x in enumerate(texts) for c in (1, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    there = con.execute(queries.ORACLES[name])
    names = [x[0] for x in there.description]
    assert sorted(map(repr, map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(repr, there.fetchall()))
