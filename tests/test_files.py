"""Readers, writers and streams on small files."""

import shutil

import pytest

from sparkloom.sources import files
from sparkloom.streaming import events


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n')
    path = str(tmp_path / "a.jsonl")
    assert [r.a for r in files.read_jsonl(spark, path, "a int", strict=False).collect() if r.a] == [1]
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, "a int").collect()
    rows = files.read_jsonl_or_text(spark, path).selectExpr("line", "parsed is null as plain").collect()
    assert [(r.line, r.plain) for r in rows] == [('{"a": 1}', False), ("not json", True)]


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿k,v\n1,"two\nlines"\n'.encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).select("k", "v").collect()] == [("1", "two\nlines")]


def test_xml_pages(spark, tmp_path):
    page = "<page><title>{0}</title><ns>{1}</ns><revision><text bytes='3'>{2}</text></revision></page>"
    (tmp_path / "a.xml").write_text("<w>" + page.format("A", 0, "abc") + page.format("B", 1, "no") + "</w>")
    assert [(r.title, r.text) for r in files.read_pages_xml(spark, str(tmp_path / "a.xml")).collect()] == [("A", "abc")]


def test_markdown_and_sink(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# T\nbody")
    (tmp_path / "d" / "README.md").write_text("no")
    assert [r.text for r in files.read_markdown(spark, str(tmp_path / "d")).collect()] == ["# T\nbody"]
    files.write_csv(spark.createDataFrame([(1, "a", "b")], "k int, x string, extra string").coalesce(1), str(tmp_path / "csv"), ["k", "x"])
    assert next((tmp_path / "csv").glob("part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbfk,x\n")
    assert [tuple(r) for r in files.with_whole_number(files.read_csv(spark, str(tmp_path / "csv")), "k", 1, 5).collect()] == [(1, "a")]


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "a.parquet")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        events.drain(events.once_only(events.read_events(spark, str(tmp_path / "in"))), out, mark)
    assert spark.read.parquet(out).count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
