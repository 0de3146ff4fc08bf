"""Rules on their model rows against results worked out by hand, and base operators against brute force."""

import re

import pytest

from sparkloom import queries
from sparkloom.operators import chunking, similar
from sparkloom.plans.tabled import MODELS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WANT = {
    "choice_parser": {(1, "다음 중 옳은 것은\n?", 4, "다음 중 옳은 것은 ?|① 하나 계속 , 끝|② 둘|③ 셋|④ 넷"), (2, "보기 ① 은 본문이다\n끝", 0, "보기 ① 은 본문이다 끝")},
    "statement_splitter": {(1, "ㄱ|첫째 진술은 참이라고 한다;ㄴ|둘째 진술은 거짓이라 한다"), (2, "①|하나의 진술이 여기에 있다")},
    "schema_slimming": {(1, "CREATE TABLE b (y INT);\n\nCREATE TABLE c (z INT);", True), (2, "CREATE TABLE a (x INT);", False), (3, "CREATE TABLE a (x INT);", True)},
    "front_matter": {(1, "title: A law;date: 20240101", "Body here"), (2, "", "No front")},
    "statute_context": {(1, "art 1\n\nart 2"), (2, "")},
    "excerpt_budget": {(1, 1, 500), (1, 2, 600)},
    "article_references": {(1, "제12조의3"), (2, "제5조"), (3, ""), (4, "제7조 제12조의3")},
    "split_prompt": {(1, "CREATE TABLE a (b INT)", "how many?"), (2, "CREATE TABLE c (d INT)", "list all"), (3, "", "no marker")},
    "valid_answer_code": {(1,), (2,), (7,)},
    "labelled_qa_rows": {(1, "Topic: sums\nQuestion: 1+1?", "2"), (2, "Question: why?", "so")},
    "drop_em_f1": {(0.333333333, 0.5)},
    "resume_step_offset": {(1, 300, 0), (2, 120, 300), (3, 80, 420)},
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_models(spark, name):
    assert {tuple(r) for r in MODELS[name](spark, SF).collect()} == WANT[name]


def test_every_query_reads_a_table():
    assert not [name for name, sql in queries.ORACLES.items() if not set(TABLES) & set(re.findall(r"\w+", sql))]
    assert all("documents" in queries.ORACLES[name] for name in MODELS)


def test_frames_hold_together(spark):
    frames = {r.doc_id: r for r in queries.QUERIES["frame_tokens"](spark, SF).collect()}
    spans = queries.QUERIES["v1_index"](spark, SF).orderBy("inst_start").collect()
    at = 0
    for r in spans:  # gapless, in order, and as long as the frames
        assert (r.inst_start, r.resp_start) == (at, at + r.inst_len)
        assert (frames[r.doc_id].inst_len, frames[r.doc_id].resp_len) == (r.inst_len, r.resp_len)
        assert r.inst_len + r.resp_len <= 256
        at += r.inst_len + r.resp_len
    assert {r.inst_len + r.resp_len for r in frames.values() if r.fate == "truncated"} == {256}
    assert queries.QUERIES["written_lengths"](spark, SF).first().total_length == at
    epochs = queries.QUERIES["v1_epochs"](spark, SF).collect()
    for e in (0, 1):
        own = sorted((r.pos, r.doc_id) for r in epochs if r.epoch == e)
        assert [p for p, _ in own] == list(range(len(spans))) and {d for _, d in own} == set(frames)


def test_distractors_come_from_the_whole_group(spark):
    rows = queries.QUERIES["distractor_sampling"](spark, SF).collect()
    kinds = {r.doc_id: (r.toxic, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(kinds[r.doc_id] == kinds[r.other] and r.doc_id != r.other for r in rows)
    sizes = {}
    for k in kinds.values():
        sizes[k] = sizes.get(k, 0) + 1
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.other)
    assert all(len(got.get(d, ())) == min(4, sizes[k] - 1) for d, k in kinds.items())
    assert {r.other for r in rows} == {d for d, k in kinds.items() if sizes[k] > 1}  # everyone is drawn


def test_containment_equals_all_pairs(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    docs = [(1, "start " + text + " end"), (2, text[:150]), (3, "a tiny one"), (4, None), (5, "x" * 40 + "needle of twenty chars" + "y" * 9), (6, "")]
    items = [(1, text[10:170]), (2, "tiny"), (3, "needle of twenty chars"), (4, "x" * 35), (5, text[20:80]), (6, "not there at all, this is a long sentence")]
    got = similar.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, i) for d, t in docs for i, x in items if t and x in t)


def test_short_texts_are_chunks_unchanged():
    assert chunking.cut("  a\n\nb ", 100, 5, ("\n\n",), 0.55) == ["  a\n\nb "]
    assert chunking.cut("   ", 100, 5, ("\n\n",), 0.55) == []
    assert chunking.cut("a" * 70 + "\n\n" + "b" * 50, 100, 10, ("\n\n",), 0.55) == ["a" * 70, "a" * 10 + "\n\n" + "b" * 50]
