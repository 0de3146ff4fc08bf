"""Pairs of sets with a large overlap coefficient, size(A and B) / min(size(A), size(B)), by prefixes.

Words are put in one order, rare ones first. A pair that reaches the threshold shares at least
o = ceil(threshold * m) words, m being the smaller size, so the smaller set's first m - o + 1 words
hold one of the other's. Only those are joined with the words of the larger sets, and the places of
the first common word bound what the rest can add. A word that nearly all sets hold stands last in
its sets and makes pairs only where a set has too little else.

Any order gives the same pairs, so only the most frequent words are counted exactly: HOT of them,
which bounds what goes to the tasks; all others come before these, by their spelling.

Cases: ids are distinct and sets hold distinct words; empty and null sets have no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import settled, slices

HOT = 10_000


def _hot_words(left: DataFrame, right: DataFrame) -> dict[str, int]:
    """Place of each of the HOT most frequent words of both sides, the most frequent last."""
    words = left.select(F.explode("words").alias("w")).unionAll(right.select(F.explode("words").alias("w")))
    top = words.groupBy("w").count().filter("count > 1").orderBy(F.desc("count"), "w").limit(HOT).collect()
    return {r.w: len(top) - k for k, r in enumerate(top)}


def needed(threshold: float, size: int) -> int:
    """The fewest common words that reach the threshold when the smaller set has ``size`` words."""
    o = max(1, math.floor(threshold * size))
    return o if o / size >= threshold else o + 1


def _placed(sets: DataFrame, hot: dict[str, int], threshold: float, prefix: bool) -> DataFrame:
    """id, size, word, place of all words of each set, or of those that a smaller set has to show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, sizes, found, places = [], [], [], []
            for row, words in enumerate(batch.column(1).to_pylist()):
                if words:
                    n = len(words)
                    order = sorted(words, key=lambda w: (hot.get(w, 0), w))[: n - needed(threshold, n) + 1 if prefix else n]
                    kept.append(np.full(len(order), row))
                    sizes.append(np.full(len(order), n, np.int32))
                    places.append(np.arange(len(order), dtype=np.int32))
                    found.append(pa.array(order, pa.string()))
            if kept:
                columns = [batch.column(0).take(pa.array(np.concatenate(kept))), pa.array(np.concatenate(sizes)), pa.concat_arrays(found), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "word", "place"])

    return sets.mapInArrow(run, "id long, size int, word string, place int")


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: ids of pairs whose first common word leaves room for the threshold. Sets are (id, words)."""
    hot = _hot_words(left, right)
    found = []
    for small, large, names, within in ((left, right, ("a", "b"), F.col("s.size") <= F.col("l.size")), (right, left, ("b", "a"), F.col("s.size") < F.col("l.size"))):
        s, t = _placed(small, hot, threshold, True).alias("s"), _placed(large, hot, threshold, False).alias("l")
        met = s.join(t, (F.col("s.word") == F.col("l.word")) & within)
        # the common word that comes first in the order has the least place on both sides
        first = met.groupBy(F.col("s.id").alias(names[0]), F.col("l.id").alias(names[1])).agg(F.min("s.place").alias("i"), F.min("l.place").alias("j"), F.first("s.size").alias("m"), F.first("l.size").alias("n"))
        room = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
        found.append(first.filter(room / F.col("m") >= threshold).select("a", "b"))
    return found[0].unionByName(found[1])


def overlap_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, overlap of all pairs of (id, words) that reach the threshold."""
    # sets are made once: each side is read for its frequent words, as the smaller, as the larger, and to verify
    own = [settled(x.select("id", "words").filter(F.size("words") > 0)) for x in (left, right)]
    pairs = candidate_pairs(*own, threshold)
    full = pairs.join(own[0].select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(own[1].select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    share = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
    return full.select("a", "b", share.alias("overlap")).filter(F.col("overlap") >= threshold)
