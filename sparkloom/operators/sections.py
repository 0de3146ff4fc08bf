"""Sections of texts with headings, as a tree, by one pass over the lines.

A heading ends the section before it; it is a child of the nearest heading before it of a lower
level. Lines within fences are no headings. A heading that holds a mark of deletion ends what is
before it and has no row of its own, nor have its lines.

Cases: null and empty texts have no sections; what stands before the first heading is section 0 of
level 0 if it isn't blank; a text without headings is that one section; a section may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")


@dataclass
class Section:
    level: int
    title: str
    parent: int | None
    first: int
    last: int = 0
    until: int = 0
    deleted: bool = False


def sections(text: str | None, deleted: str = "") -> list[tuple[int, int, int | None, str, int, int, int, str]]:
    """(number, level, parent's number, title, first line, line after the own content, line after the subtree, content)."""
    lines = (text or "").split("\n")
    found = [Section(0, "", None, 0)]
    above: list[int] = [0]
    fenced = False

    def close(level: int, at: int) -> None:
        found[-1].last = at
        while above and found[above[-1]].level >= level:
            found[above.pop()].until = at

    for n, line in enumerate(lines):
        if line.startswith("```"):
            fenced = not fenced
        head = None if fenced else _HEADING.match(line)
        if head:
            close(max(1, len(head[1])), n)
            parent = above[-1] if above and above[-1] else None
            found.append(Section(len(head[1]), head[2], parent, n, deleted=bool(deleted) and deleted in head[2]))
            above.append(len(found) - 1)
    close(0, len(lines))
    rows = []
    for k, s in enumerate(found):
        body = "\n".join(lines[s.first + (k > 0) : s.last]).strip()
        if not s.deleted and (k or body):
            rows.append((k, s.level, s.parent, s.title, s.first, s.last, s.until, body))
    return rows


_ROWS = "section int, level int, parent int, title string, first_line int, last_line int, tree_line int, content string"


def section_rows(docs: DataFrame, key: str, text: str, deleted: str = "") -> DataFrame:
    """One row per section of each text, with the text's key."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in sections(t, deleted)]
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [key, *(x.split()[0] for x in _ROWS.split(", "))])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {_ROWS}")


def task_rows(tree: DataFrame, key: str, holding: str, body: str, most: int = 8) -> DataFrame:
    """Training rows of sectioned texts: key, kind, part, instruction, response.

    Where a section's title begins with ``holding`` and it says 20 characters or more, it is extracted as
    JSON; where one begins with ``body`` and says 200 or more, it is summarised. Texts with neither give
    up to ``most`` sections of 80 characters or more, and else, of 300 or more, one summary.
    """
    first = lambda begin: F.min(F.when(F.col("title").startswith(begin), F.struct("section", "content")))
    whole = tree.groupBy(key).agg(
        first(holding).alias("h"), first(body).alias("b"), F.max(F.when(F.col("section") == F.lit(1), F.col("title"))).alias("name"), F.sum(F.length("content")).alias("n"),
        F.count_if((F.length("content") >= 80) & (F.col("level") > 0)).alias("long"), F.min(F.struct("section", "content")).alias("lead"),
    )
    extract = (F.length("h.content") >= 20) & F.col("h").isNotNull()
    summary = (F.length("b.content") >= 200) & F.col("b").isNotNull()
    sectioned = F.coalesce(F.col("h").isNotNull() | F.col("b").isNotNull(), F.lit(False))
    json = whole.filter(extract).select(
        key, F.lit("extract").alias("kind"), F.lit(0).alias("part"), F.concat(F.lit("Give name and holding as JSON.\n\n"), "h.content").alias("instruction"), F.to_json(F.struct("name", F.substring("h.content", 1, 700).alias("holding"))).alias("response")
    )
    short = whole.filter(summary).select(key, F.lit("summary").alias("kind"), F.lit(0).alias("part"), F.concat(F.lit("Summarise.\n\n"), "b.content").alias("instruction"), F.concat_ws("\n", "name", F.substring(F.coalesce("h.content", "b.content"), 1, 800)).alias("response"))
    plain = tree.join(whole.filter(~sectioned).select(key, "long"), key).filter((F.length("content") >= 80) & (F.col("level") > 0))
    placed = plain.withColumn("part", F.row_number().over(W.partitionBy(key).orderBy("section"))).filter(F.col("part") <= most)
    parts = placed.select(key, F.lit("section").alias("kind"), "part", F.concat_ws("\n", "title", "content").alias("instruction"), F.substring("content", 1, 520).alias("response"))
    rest = whole.filter(~sectioned & (F.col("long") == 0) & (F.col("n") >= 300)).select(key, F.lit("whole").alias("kind"), F.lit(0).alias("part"), "lead.content", F.substring("lead.content", 1, 900).alias("response")).withColumnRenamed("content", "instruction")
    return json.unionByName(short).unionByName(parts).unionByName(rest)
