"""Token batches for several ranks: the longest run of samples that fits, spread by longest first.

The order of samples fixes the batches, so planning is sequential; it runs over (id, length) alone,
in hashed shards that pack in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_first(lengths: list[int]) -> list[int]:
    """The order in which samples are placed; of equal lengths the later goes first."""
    return sorted(range(len(lengths)), key=lambda k: (-lengths[k], -k))


class _Loads:
    """Loads of ranks as a binary heap whose root is raised and sinks.

    Which of several equally loaded ranks is next follows from where they stand: a load sinks only below
    a smaller one, and to the left where both below are equal.
    """

    def __init__(self, ranks: int):
        self.heap = [(0, r) for r in range(ranks)]

    def add(self, length: int) -> int:
        heap, at = self.heap, 0
        load, rank = heap[0][0] + length, heap[0][1]
        while 2 * at + 1 < len(heap):
            below = min(range(2 * at + 1, min(2 * at + 3, len(heap))), key=lambda k: heap[k][0])
            if load <= heap[below][0]:
                break
            heap[at], at = heap[below], below
        heap[at] = (load, rank)
        return rank


def spread(lengths: list[int], ranks: int) -> tuple[list[int], int]:
    """The rank of each sample, the longest going first to the least loaded, and the largest load."""
    loads, place = _Loads(ranks), [0] * len(lengths)
    for k in longest_first(lengths):
        place[k] = loads.add(lengths[k])
    return place, max(load for load, _ in loads.heap)


def batches(lengths: list[int], capacity: int, ranks: int):
    """(first, end, ranks of the samples) of each batch; a tail with fewer samples than ranks is dropped."""
    at = 0
    while at < len(lengths):
        end, total = at, 0
        while end < len(lengths) and total < capacity * ranks:
            total += lengths[end]
            end += 1
        low, high = 1, end - at + 1
        while high - low > 1:
            mid = (low + high) // 2
            if spread(lengths[at : at + mid], ranks)[1] <= capacity:
                low = mid
            else:
                high = mid
        if low < ranks:
            return
        yield at, at + low, spread(lengths[at : at + low], ranks)[0]
        at += low


PACKED = "shard int, batch long, rank int, slot int, sample_id long"


def _pack_shards(dealt: DataFrame, capacity: int, ranks: int) -> DataFrame:
    """Packed samples of each shard, and its tail as rows without a batch."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("sample_id")
        shard, ids, lengths = int(own["shard"].iloc[0]), own["sample_id"].tolist(), own["length"].tolist()
        out, done = [], 0
        for number, (a, end, place) in enumerate(batches(lengths, capacity, ranks)):
            slots = np.argsort(longest_first(lengths[a:end])).tolist()
            out += [(shard, number, rank, slot, ids[a + k]) for k, (rank, slot) in enumerate(zip(place, slots, strict=True))]
            done = end
        out += [(shard, None, None, None, x) for x in ids[done:]]
        return pd.DataFrame(out, columns=["shard", "batch", "rank", "slot", "sample_id"]).astype({"batch": "Int64", "rank": "Int32", "slot": "Int32"})

    return dealt.groupBy("shard").applyInPandas(run, PACKED)


def pack(rows: DataFrame, capacity: int, ranks: int, shards: int | None = None, shard_rows: int = 100_000) -> DataFrame:
    """shard, batch, rank, slot, sample_id of the packed samples of rows (sample_id, length).

    Samples are dealt into ``shards`` by a hash of their ids, whatever their number; choose it so that
    a task holds a shard's ids and lengths. Without it they are counted, and about ``shard_rows`` make a
    shard. What a shard leaves over, fewer samples than ranks, goes to one more shard, numbered after the
    others; only there are samples dropped. Within a rank's sequence samples stand by slot.
    """
    if shards is None:
        shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("sample_id"), F.lit(shards)).cast("int"))
    first = _pack_shards(dealt, capacity, ranks)
    left = first.filter(F.col("batch").isNull()).select("sample_id").join(rows, "sample_id").withColumn("shard", F.lit(shards))
    return first.filter(F.col("batch").isNotNull()).unionByName(_pack_shards(left, capacity, ranks).filter(F.col("batch").isNotNull()))
