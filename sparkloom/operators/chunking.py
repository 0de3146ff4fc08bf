"""Cutting long texts into chunks at headings, paragraphs or lines, by few texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.session import slices


def boundary(text: str, start: int, end: int, marks: tuple[str, ...], least: int) -> int:
    """Where a chunk from start ends: before the last mark past ``least``, trying the marks in order, or at end."""
    places = (text.rfind(mark, least, end) for mark in marks)
    return next((at for at in places if at > start), end)


def cut(text: str, most: int, overlap: int, marks: tuple[str, ...], floor: float) -> list[str]:
    """Chunks of at most ``most`` characters; a text that fits is its own chunk, unchanged.

    A cut goes before a mark past ``floor`` of the room; the next chunk begins ``overlap`` characters before it.
    """
    if len(text) <= most:
        return [text] if text.strip() else []
    spans, start = [], 0
    while start < len(text):
        whole = start + most >= len(text)
        end = len(text) if whole else boundary(text, start, start + most, marks, start + int(most * floor))
        spans.append((start, end))
        start = len(text) if whole else max(end - overlap, start + 1)
    return [piece for a, b in spans if (piece := text[a:b].strip())]


KINDS = {"heading": (("\n#", "\n\n"), 0.55, True), "paragraph": (("\n\n",), 0.55, True), "newline": (("\n",), 0.6, False)}


def chunks(docs: DataFrame, kind: str, most: int, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index and body of the chunks of each text; null and blank texts have none."""
    marks, floor, overlaps = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [cut(x or "", most, overlap if overlaps else 0, marks, floor) for x in batch.column(1).to_pylist()]
            rows = pa.array([row for row, own in enumerate(found) for _ in own], pa.int64())
            places = pa.array([k for own in found for k in range(len(own))], pa.int32())
            bodies = pa.array([x for own in found for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), places, bodies], [key, "chunk_index", "body"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, body string")
