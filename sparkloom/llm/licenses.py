"""Licence scans by ordered signature rules.

A text is reduced to its words, lower-cased, with one space between. One pass of an automaton over
all literal beginnings finds where a rule may apply, and only there is its regular expression tried,
so that a text costs its length plus its hits. A detection after "licensed under the" or an SPDX tag
takes in that lead and rises in priority. A detection that lies within another of higher priority,
or within a longer one of the same, is suppressed: "GNU General Public License version 3" names one
licence and not also the general one. Given phrases are rules too, and are always reported.

Defined cases: a null text counts as empty, without words; repeated rows and ids keep their rows; of
detections with equal priority and place the first label in order stays; an empty table gives no
rows; a text of any length is scanned whole; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_arrow
from sparkloom.llm.license_rules import RULES
from sparkloom.llm.words import ALNUM, text_bytes

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Priority and score by kind.
KINDS = {"tag": (6, 0.99), "text": (5, 0.97), "notice": (4, 0.95), "name": (3, 0.85), "short": (2, 0.7), "phrase": (1, 0.6), "hint": (0, 0.3)}

_TAG = re.compile(r" spdx licen[cs]e identifier $")
_LEAD = re.compile(
    r" (?:licen[cs]ed?|licen[cs]es|licensing|released|distributed|available|published|provided|covered|governed|made available|redistribut\w+|used|offered)(?: [^ ]+){0,4}? (?:under|by|is|with|as|to)"
    r"(?: an?| the)?(?: terms(?: and conditions)?(?: of)?)?(?: an?| the)? $"
)
#: Characters before a name in which its lead is looked for.
_LEAD_CHARS = 96


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: re.Pattern[str]
    literal: str


def literal_start(pattern: str) -> str:
    """The text that every match of ``pattern`` begins with."""
    plain = re.match(r"[a-z0-9 ]*", pattern)[0]
    return plain[:-1] if pattern[len(plain) : len(plain) + 1] in ("?", "*", "{") else plain


def _starts(pattern: str) -> list[str]:
    """Patterns with a literal start: a leading choice is taken apart."""
    choice = re.match(r"\(\?:([a-z0-9 |]+)\)(?![?*{])", pattern)
    return [x + pattern[choice.end() :] for x in choice[1].split("|")] if choice else [pattern]


@lru_cache(maxsize=4)
def rules(phrases: tuple[tuple[str, str], ...] = PHRASES) -> tuple[Rule, ...]:
    lines = [line.split(" ", 2) for line in RULES.strip().split("\n")]
    lines += [[label, "phrase", re.escape(phrase).replace("\\ ", " ")] for phrase, label in phrases]
    return tuple(Rule(label, kind, re.compile(one + "(?= )"), literal_start(one)) for label, kind, text in lines for one in _starts(text))


@lru_cache(maxsize=4)
def gate(phrases: tuple[tuple[str, str], ...] = PHRASES) -> ahocorasick.Automaton:
    """Literal starts of all rules, each at a word's beginning, with the rules that begin so."""
    found: dict[str, list[Rule]] = {}
    for rule in rules(phrases):
        if len(rule.literal.strip()) < 2:
            raise ValueError(f"rule without a literal start: {rule.pattern.pattern}")
        found.setdefault(" " + rule.literal, []).append(rule)
    automaton = ahocorasick.Automaton()
    for word, own in found.items():
        automaton.add_word(word, (len(word), tuple(own)))
    automaton.make_automaton()
    return automaton


@dataclass(frozen=True)
class Detection:
    label: str
    kind: str
    start: int
    stop: int


def detections(text: str, phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[Detection]:
    """All matches in a text of words with one space before, between and after, in no set order."""
    out = []
    for end, (size, own) in gate(phrases).iter(text):
        at = end - size + 2  # behind the space
        lead = None
        for rule in own:
            match = rule.pattern.match(text, at)
            if not match:
                continue
            kind, start = rule.kind, at
            if kind in ("name", "short", "id"):
                if lead is None:
                    before = text[max(0, at - _LEAD_CHARS) : at]
                    tag = _TAG.search(before)
                    lead = (tag or _LEAD.search(before) or False, "tag" if tag else "notice")
                if lead[0]:
                    kind, start = lead[1], at - len(lead[0][0]) + 1
                elif kind == "id":
                    continue
            out.append(Detection(rule.label, kind, start, match.end()))
    return out


def resolved(found: list[Detection]) -> list[Detection]:
    """What remains once a detection within another of higher rank is suppressed, by start.

    Containment is transitive, so a detection is held against all that rank above it, suppressed or not.
    """
    out: list[Detection] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    above: list[Detection] = []
    for priority in sorted({KINDS[d.kind][0] for d in found}, reverse=True):
        level = sorted((d for d in found if KINDS[d.kind][0] == priority), key=lambda d: (d.start, -d.stop, d.label))
        stops = np.array([d.stop for d in level])
        inner = np.concatenate([[-1], np.maximum.accumulate(stops)[:-1]]) >= stops  # within one of its own level
        if above:
            k = np.searchsorted(starts, [d.start for d in level], "right")
            inner |= np.where(k > 0, reach[np.maximum(k - 1, 0)], -1) >= stops
        out += [d for d, x in zip(level, inner.tolist(), strict=True) if not x]
        above = sorted(above + level, key=lambda d: d.start)
        starts, reach = np.array([d.start for d in above]), np.maximum.accumulate([d.stop for d in above])
    return sorted(out, key=lambda d: (d.start, d.stop, d.label))


def scan(raw: bytes, phrases: tuple[tuple[str, str], ...] = PHRASES) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, str, int, int]]]:
    """Number of words; (label, first word, word after) of each phrase; the same with the kind of each detection that remains."""
    words = ALNUM.findall(raw.lower())
    if not words:
        return 0, [], []
    text = " " + b" ".join(words).decode() + " "
    found = detections(text, phrases)
    if not found:
        return len(words), [], []
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    spaces = np.flatnonzero(data == 32)

    def place(d: Detection) -> tuple[int, int]:
        first, last = np.searchsorted(spaces, [d.start, d.stop])
        return int(first) - 1, int(last)

    base = sorted({(d.label, *place(d)) for d in found if d.kind == "phrase"}, key=lambda x: x[1:])
    return len(words), base, [(d.label, d.kind, *place(d)) for d in resolved(found) if d.kind != "phrase"]


_SCANNED = "doc_id long, n_words long, phrases array<struct<label:string,first:long,stop:long>>, found array<struct<label:string,kind:string,first:long,stop:long>>"
_ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("phrases", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))),
        ("found", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def scan_documents(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, the places of phrases, and the detections that remain with their kinds and places in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanned = [scan(raw, phrases) for raw in batch.column(1).to_pylist()]
            n, base, found = zip(*scanned, strict=True) if scanned else ((), (), ())
            rows = [[dict(zip(names, x, strict=True)) for x in own] for part, names in ((base, ("label", "first", "stop")), (found, ("label", "kind", "first", "stop"))) for own in part]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(rows[: len(n)], _ROWS.types[2]), pa.array(rows[len(n) :], _ROWS.types[3])]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), run, _SCANNED)


def license_scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    first = F.transform("phrases", lambda x: x["first"])
    base = F.transform("phrases", lambda x: x["label"])
    by_kind = F.create_map(*(F.lit(x) for kind, (_, score) in KINDS.items() for x in (kind, score)))
    scores = F.concat(F.array(F.lit(0.0)), F.transform("phrases", lambda _: F.lit(KINDS["phrase"][1])), F.transform("found", lambda x: by_kind[x["kind"]]))
    return scan_documents(docs, phrases).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        F.array_max(scores).alias("score"),
    )
