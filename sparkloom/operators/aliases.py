"""Which of many literal names a text holds: an automaton over the whole alias table, in one pass over the texts.

An alias table has ord, alias and canonical. Texts and aliases are compared without white space and in
lower case. A text's names come in the order of their first alias in the table, each once, up to a
cap; texts without any get the names of a fallback for their group.

The table is dealt into automata of at most SHARD_ALIASES each, so that a worker's memory is bounded;
each shard takes a pass of its own over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ALIASES = 200_000
_SPACE = re.compile(r"\s+")


def compact(text: str | None) -> str:
    return _SPACE.sub("", text or "").lower()


def automaton(rows: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Of (number, alias) rows; an alias that repeats keeps its smallest number."""
    found: dict[str, int] = {}
    for number, alias in sorted(rows):
        if compact(alias):
            found.setdefault(compact(alias), number)
    out = ahocorasick.Automaton()
    for alias, number in found.items():
        out.add_word(alias, number)
    if found:
        out.make_automaton()
    return out


def matches(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id and the numbers of the aliases that each text holds, as rows (doc_id, ord); texts without any give none."""
    n = aliases.count()
    shards = max(1, -(-n // SHARD_ALIASES))
    dealt = aliases.select(F.col("ord").cast("long"), F.col("alias").cast("string"), (F.pmod(F.xxhash64("alias"), F.lit(shards))).alias("shard"))
    out = None
    for shard in range(shards):
        table = [(r[0], r[1]) for r in dealt.filter(F.col("shard") == shard).select("ord", "alias").filter("alias is not null").toLocalIterator()]

        def run(batches: Iterator[pa.RecordBatch], table: list = table) -> Iterator[pa.RecordBatch]:
            machine = automaton(table)
            for batch in batches:
                ids, found = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = {number for _, number in machine.iter(compact(text))} if len(machine) else ()
                    ids += [key] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "ord"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ord long")
        out = rows if out is None else out.unionByName(rows)
    return out


def entities(docs: DataFrame, aliases: DataFrame, group: str, fallback: Column, cap: int = 5) -> DataFrame:
    """doc_id and names: the canonical names of each text in table order, at most ``cap``, else its fallback (an array column over ``group``)."""
    named = matches(docs, aliases).join(aliases.select(F.col("ord").cast("long").alias("ord"), "canonical"), "ord")
    first = named.groupBy("doc_id", "canonical").agg(F.min("ord").alias("ord"))
    lists = first.groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "canonical"))), lambda x: x["canonical"]), 1, cap).alias("found"))
    return docs.select("doc_id", group).join(lists, "doc_id", "left").select("doc_id", F.coalesce("found", F.slice(fallback, 1, cap)).alias("names"))
