"""Text, links and tables of raw pages from one pass over their tags.

A state machine keeps one list of text nodes; elements are ranges of it, so that nested and unclosed
elements cost nothing extra. An end tag closes the last open element of its name and what is open
within; one without a start is skipped. Scripts, styles, comments and declarations have no text.

Cases: null or empty pages have an empty text, no links and no tables; links without a target are
left out; a page cut off within a tag ends before it. References such as ``&amp`` without their
semicolon count as what they stand for, or stay as they are written (``closed``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
_CELLS, _BEFORE = frozenset(("td", "th")), frozenset(("p", "span"))
#: Paragraphs and spans before a table that make up its context.
CONTEXT = 40
#: An ampersand that begins no reference with its semicolon, and what stands for it while a page is read.
_OPEN = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")
_MARKS = [chr(k) for k in range(0xFDD0, 0xFDF0)]


class _Element:
    __slots__ = ("first", "last", "name", "seen", "target")

    def __init__(self, name: str, first: int, seen: tuple[int, int], target: str | None):
        self.name, self.first, self.last, self.seen, self.target = name, first, None, seen, target


class PageReader(HTMLParser):
    """Reads one page; ``texts``, ``links``, ``pairs`` and ``tables`` afterwards. With ``closed`` only references with a semicolon are read as such."""

    def __init__(self, page: str | None, closed: bool = False):
        super().__init__(convert_charrefs=True)
        page = page or ""
        # a noncharacter that the page doesn't hold
        self._mark = next((m for m in _MARKS if m not in page), None) if closed else None
        if self._mark:
            page = _OPEN.sub(self._mark, page)
        self.texts: list[str] = []
        self._open: list[_Element] = []
        self._of: dict[str, list[_Element]] = {k: [] for k in ("a", "dt", "dd", "cell", "before", "table")}
        self._silent = 0
        self.feed(page)
        self.close()
        self._leave(0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        kind = "cell" if tag in _CELLS else "before" if tag in _BEFORE else tag
        element = _Element(tag, len(self.texts), (len(self._of["before"]), len(self._of["cell"])), self._plain(dict(attrs).get("href")) if tag == "a" else None)
        if kind in self._of:
            self._of[kind].append(element)
        self._silent += tag in _SILENT
        self._open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._leave(len(self._open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k].name == tag:
                self._leave(k)
                return

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self.texts.append(self._plain(data))

    def _plain(self, value: str | None) -> str | None:
        return value.replace(self._mark, "&") if value and self._mark else value

    def _leave(self, k: int) -> None:
        for element in self._open[k:]:
            element.last = (len(self.texts), len(self._of["cell"]))
            self._silent -= element.name in _SILENT
        del self._open[k:]

    def text_of(self, element: _Element, by: str = " ") -> str:
        return by.join(x for x in map(str.strip, self.texts[element.first : element.last[0]]) if x)

    def text(self) -> str:
        """Text nodes by line, white space squeezed, without empty lines."""
        lines = "\n".join(self.texts).replace("﻿", "").replace("\r", "\n").split("\n")
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)

    def links(self, base: str, ending: str = "") -> list[tuple[str, str]]:
        """Address and text of the links whose target ends so."""
        return [(urljoin(base or "", a.target.strip()), self.text_of(a)) for a in self._of["a"] if a.target and a.target.endswith(ending)]

    def pairs(self) -> dict[str, str]:
        """Terms with the descriptions that follow them; the first of a term stays."""
        out: dict[str, str] = {}
        dds = iter(self._of["dd"])
        dd = next(dds, None)
        for k, dt in enumerate(self._of["dt"]):
            following = self._of["dt"][k + 1].first if k + 1 < len(self._of["dt"]) else len(self.texts) + 1
            while dd is not None and dd.first < dt.first:
                dd = next(dds, None)
            if dd is not None and dd.first < following:
                out.setdefault(self.text_of(dt), self.text_of(dd))
        return out

    def tables(self) -> list[tuple[str, list[str]]]:
        """Context and cells of each table. The context is the text of the elements that began before it, the nearest 40."""
        out = []
        for table in self._of["table"]:
            before, cell = table.seen
            near = [self.text_of(x) for x in self._of["before"][max(0, before - CONTEXT) : before]]
            out.append((" ".join(x for x in near if x), [self.text_of(x) for x in self._of["cell"][cell : table.last[1]]]))
        return out


def number_answers(cells: list[str], headers: tuple[str, str]) -> list[tuple[int, str]]:
    """(number, answer) of neighbouring cells of a table that names both headers."""
    joined = " ".join(cells)
    if not all(h in joined for h in headers):
        return []
    values = [re.sub(r"\s+", "", c) for c in cells]
    return [(int(a), b) for a, b in zip(values, values[1:], strict=False) if re.fullmatch(r"[0-9]{1,3}", a) and b and b not in headers]


_PAGE = "text string, links array<struct<url:string,label:string>>, pairs map<string,string>, tables array<struct<context:string,cells:array<string>>>"
_TYPES = pa.schema(
    [
        ("text", pa.string()),
        ("links", pa.list_(pa.struct([("url", pa.string()), ("label", pa.string())]))),
        ("pairs", pa.map_(pa.string(), pa.string())),
        ("tables", pa.list_(pa.struct([("context", pa.string()), ("cells", pa.list_(pa.string()))]))),
    ]
)


def read_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", ending: str = "", closed: bool = False) -> DataFrame:
    """The key with the text, links, term pairs and tables of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [(PageReader(page, closed), base) for base, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [
                pa.array([p.text() for p, _ in read], pa.string()),
                pa.array([[{"url": u, "label": t} for u, t in p.links(base, ending)] for p, base in read], _TYPES.types[1]),
                pa.array([list(p.pairs().items()) for p, _ in read], _TYPES.types[2]),
                pa.array([[{"context": c, "cells": x} for c, x in p.tables()] for p, _ in read], _TYPES.types[3]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *_TYPES.names])

    return pages.select(key, url, html).mapInArrow(run, f"{key} {kind}, {_PAGE}")


def attachments(read: DataFrame, key: str, number: str, date_term: str | Column) -> DataFrame:
    """One row per link: url, label, the number that a pattern finds in the address, and the page's description of a term."""
    rows = read.select(key, F.explode("links").alias("x"), F.element_at("pairs", date_term).alias("dated"))
    found = F.regexp_extract("x.url", number, 1)
    return rows.select(key, "x.url", "x.label", F.when(found != "", found).alias("file_id"), "dated")


def answers(read: DataFrame, key: str, headers: tuple[str, str]) -> DataFrame:
    """One row per number and answer of the tables that name both headers, with the table's context; of a repeated number the last stays."""
    pairs = F.udf(lambda cells: number_answers(cells, headers), "array<struct<number:int,answer:string>>")
    rows = read.select(key, F.posexplode("tables").alias("table_no", "t")).select(key, "table_no", "t.context", F.posexplode(pairs("t.cells")).alias("at", "p"))
    last = rows.groupBy(key, "context", "p.number").agg(F.max(F.struct("table_no", "at", "p.answer")).alias("m"))
    return last.select(key, "context", "number", F.col("m.answer").alias("answer"))
