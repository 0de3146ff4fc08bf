"""Sequence-match ratio against held-out texts, behind cheap gates on shared words and length.

Equal texts, and those of which one holds the other's first 120 characters, count 1.0 before any
gate. White space and circled digits are left out of texts first, other than for words.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS = 900
#: Characters that the containment test looks for, and those of a gram.
HEAD, GRAM = 120, 16
OVERLAP, SHORT, LONG = 0.18, 0.25, 3.5


def ratio(a: str, b: str) -> float:
    """1.0 for equal texts or where one holds the other's first 120 characters, else difflib's ratio."""
    if a == b or (len(b) > 120 and b[:120] in a) or (len(a) > 120 and a[:120] in b):
        return 1.0
    return SequenceMatcher(None, a[:CHARS], b[:CHARS]).ratio()


def normal(text):
    """A text column without white space and circled digits."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\u2460-\u2469]+", "")


def anchors(text: str, width_of_window: int = HEAD) -> np.ndarray:
    """The least gram hash of each window of some characters; two texts with a window in common share its one."""
    h = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[width:] * np.uint64(0xD6E8FEB86659FD93)) if len(h) > width else h[:0]
        h ^= h >> np.uint64(29)
        width *= 2
    span = width_of_window - GRAM + 1
    return np.lib.stride_tricks.sliding_window_view(h, span).min(1) if len(h) >= span else h[:0]


def held(whole: DataFrame, heads: DataFrame, whole_id: str, head_id: str) -> DataFrame:
    """Pairs where a text of ``whole`` holds the first HEAD characters of a longer one of ``heads``; both have an id and norm."""

    def keys(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = np.unique(anchors(x[:HEAD] if first else x))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(found.view(np.int64))], ["id", "anchor"])

        return run

    own = whole.filter(F.length("norm") >= HEAD).select(F.col(whole_id).cast("long"), "norm").mapInArrow(keys(False), "id long, anchor long").withColumnRenamed("id", whole_id)
    long = heads.filter(F.length("norm") > HEAD)
    start = long.select(F.col(head_id).cast("long"), "norm").mapInArrow(keys(True), "id long, anchor long").withColumnRenamed("id", head_id)
    pairs = own.join(start, "anchor").select(whole_id, head_id).distinct()
    texts = pairs.join(whole, whole_id).join(long.select(head_id, F.substring("norm", 1, HEAD).alias("head")), head_id)
    return texts.filter(F.contains("norm", "head")).select(whole_id, head_id)


def containing(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """doc_id and item_id where the document holds the whole item, by an equi-join on anchors of two widths.

    Items shorter than a gram have no anchor; they are compared with every document.
    """
    found = []
    items = held_out.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for width, most in ((HEAD, None), (2 * GRAM, HEAD), (GRAM, 2 * GRAM)):
        size = F.length("item")
        own = items.filter((size >= width) if most is None else (size >= width) & (size < most))
        if own.isEmpty():
            continue

        def keys(first: bool, width: int = width):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids, values = [], []
                    for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        values.append(np.unique(anchors(x[:width] if first else x, width)))
                        ids.append(np.full(len(values[-1]), i))
                    if ids:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(values).view(np.int64))], ["id", "anchor"])

            return run

        left = texts.filter("doc_id is not null and text is not null").mapInArrow(keys(False), "id long, anchor long").withColumnRenamed("id", "doc_id")
        right = own.filter("item_id is not null").mapInArrow(keys(True), "id long, anchor long").withColumnRenamed("id", "item_id")
        pairs = left.join(right, "anchor").select("doc_id", "item_id").distinct()
        found.append(pairs.join(texts, "doc_id").join(own, "item_id").filter(F.contains("text", "item")).select("doc_id", "item_id"))
    short = items.filter(F.length("item") < GRAM)
    found.append(texts.join(short, F.contains("text", "item")).select("doc_id", "item_id"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def best_ratio(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """The best ratio of each document that passes the gates or the tests before them: doc_id, item_id, similarity.

    Candidates come from an equi-join on shared words of six letters or more; the held-out side is
    joined by key, so nothing is broadcast and no cross product is made.
    """
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)\W+"), lambda w: F.length(w) >= 6))
    left = docs.select("doc_id", words("text").alias("w"), F.length(normal("text")).alias("n"))
    right = held_out.select("item_id", words("text").alias("w"), F.length(normal("text")).alias("n"))
    a = left.select("doc_id", F.col("n").alias("an"), F.size("w").alias("aw"), F.explode("w").alias("word"))
    b = right.select("item_id", F.col("n").alias("bn"), F.size("w").alias("bw"), F.explode("w").alias("word"))
    share = F.count("*") / F.least(F.first("aw"), F.first("bw"))
    pairs = a.join(b, "word").groupBy("doc_id", "item_id").agg(share.alias("share"), (F.first("an") / F.first("bn")).alias("scale"))
    pairs = pairs.filter((F.col("share") >= OVERLAP) & F.col("scale").between(SHORT, LONG)).select("doc_id", "item_id")

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)])

    docs = docs.select("doc_id", normal("text").alias("norm")).filter("norm <> ''")
    held_out = held_out.select("item_id", normal("text").alias("norm")).filter("norm <> ''")
    texts = pairs.join(docs.select("doc_id", F.substring("norm", 1, CHARS).alias("x")), "doc_id").join(held_out.select("item_id", F.substring("norm", 1, CHARS).alias("y")), "item_id")
    scored = texts.select("doc_id", "item_id", F.round(score("x", "y"), 6).alias("similarity"))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    equal = docs.select("doc_id", digest.alias("d")).join(held_out.select("item_id", digest.alias("d")), "d").select("doc_id", "item_id")
    sure = equal.unionByName(held(docs, held_out, "doc_id", "item_id")).unionByName(held(held_out, docs, "item_id", "doc_id"))
    scored = scored.unionByName(sure.withColumn("similarity", F.lit(1.0)))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("similarity", -F.col("item_id"))).alias("m"))
    return best.select("doc_id", (-F.col("m.col2")).alias("item_id"), "m.similarity")
