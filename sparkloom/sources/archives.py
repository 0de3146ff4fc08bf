"""Members of ZIP archives, paragraphs of zipped XML documents, and answer pairs of HTML tables.

Each file or page is handled by itself in Arrow batches. A file that is no archive gives no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_HANGUL = re.compile("[가-힣]")


def member_name(info: zipfile.ZipInfo) -> str:
    """The name as stored; one without the UTF-8 flag is read as cp949 where that gives Hangul."""
    name = info.filename
    if not info.flag_bits & 0x800:
        try:
            other = name.encode("cp437").decode("cp949")
            name = other if _HANGUL.search(other) else name
        except UnicodeError:
            pass
    return "/".join(x for x in name.replace("\\", "/").split("/") if x not in ("", ".", ".."))


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield member_name(info), archive.read(info)


def paragraphs(data: bytes) -> list[str]:
    """Text of each paragraph element of an XML section: its text runs, joined."""
    local = lambda x: x.tag.rpartition("}")[2]
    found = ("".join("".join(t.itertext()) for t in p.iter() if local(t) == "t") for p in ElementTree.fromstring(data).iter() if local(p) == "p")
    return [x for x in found if x.strip()]


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """path, member and content of every file in the archives below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, content in _members(data.as_py()):
                    yield pa.RecordBatch.from_pydict({"path": [place], "member": [name], "content": pa.array([content], pa.binary())})

    return _binary(spark, path, "*.zip").mapInArrow(run, "path string, member string, content binary")


def read_hwpx(spark: SparkSession, path: str) -> DataFrame:
    """path and text of zipped XML documents: the paragraphs of their sections, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = sorted((int(m[1]), content) for name, content in _members(data.as_py()) if (m := re.search(r"section(\d+)\.xml$", name)))
                lines = [x for _, content in parts for x in paragraphs(content)]
                yield pa.RecordBatch.from_pydict({"path": [place], "text": ["\n".join(lines)]})

    return _binary(spark, path, "*.hwpx").mapInArrow(run, "path string, text string")


class _Cells(HTMLParser):
    """Cell texts of each table, in order of the page."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag in ("td", "th") and self.tables:
            self.tables[-1].append("")
            self.inside = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "table"):
            self.inside = False

    def handle_data(self, data):
        if self.inside and self.tables and self.tables[-1]:
            self.tables[-1][-1] += data.strip()


def number_pairs(html: str, headers: tuple[str, str]) -> list[tuple[int, int, str]]:
    """(table, number, answer) of neighbouring cells in the tables that name both headers."""
    parser = _Cells()
    parser.feed(html or "")
    out = []
    for k, cells in enumerate(parser.tables):
        if all(any(h in c for c in cells) for h in headers):
            body = [c for c in cells if not any(h in c for h in headers)]
            out += [(k, int(a), b) for a, b in zip(body[::2], body[1::2]) if a.isdecimal()]
    return out


def answer_tables(pages: DataFrame, headers: tuple[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per pair of a question number and its answer."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *x) for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in number_pairs(text, headers)]
            if rows:
                own, tables, numbers, answers = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(own, batch.schema.field(0).type), pa.array(tables, pa.int32()), pa.array(numbers, pa.int32()), pa.array(answers, pa.string())], [key, "table_no", "number", "answer"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, table_no int, number int, answer string")
