"""Tensors of packed sequences: inputs, labels and positions, padded, with the ends of their samples.

A sample's instruction sees itself whole and its response is predicted from it: the last instruction
id predicts the first response id, so a sample takes one place less than it has ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed value: label of places that are not learnt
IGNORED = -100


def _padded(values: Column, size: int, value: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def batch_tensors(packed: DataFrame, samples: DataFrame, capacity: int, target_only: bool = True) -> DataFrame:
    """One row for each shard, batch and rank of packed samples (sample_id, inst, resp; no list empty).

    A sequence is gathered in one row, which ``capacity`` bounds. Samples stand in the packer's slots.
    """
    rows = packed.join(samples.select("sample_id", "inst", "resp"), "sample_id").groupBy("shard", "batch", "rank").agg(F.sort_array(F.collect_list(F.struct("slot", "inst", "resp"))).alias("s"))
    prompt = (lambda x: F.array_repeat(F.lit(IGNORED), F.size(x["inst"]) - 1)) if target_only else (lambda x: F.slice(x["inst"], 2, F.greatest(F.size(x["inst"]) - 1, F.lit(0))))
    inputs = F.flatten(F.transform("s", lambda x: F.concat(x["inst"], F.slice(x["resp"], F.lit(1), F.size(x["resp"]) - 1))))
    labels = F.flatten(F.transform("s", lambda x: F.concat(prompt(x), x["resp"])))
    positions = F.flatten(F.transform("s", lambda x: F.sequence(F.lit(0), F.size(x["inst"]) + F.size(x["resp"]) - 2)))
    prefix, causal = F.transform("s", lambda x: F.size(x["inst"])), F.transform("s", lambda x: F.size(x["resp"]) - 1)
    ends = F.aggregate(F.zip_with(prefix, causal, lambda a, b: a + b), F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    whole = F.zip_with(prefix, causal, lambda a, b: a + b)
    return rows.select(
        "shard",
        "batch",
        "rank",
        _padded(inputs, capacity, 0).alias("inputs"),
        _padded(labels, capacity, IGNORED).alias("labels"),
        _padded(positions, capacity, 0).alias("position_ids"),
        _padded(prefix, capacity, 0).alias("prefix_lens"),
        _padded(causal, capacity, 0).alias("causal_lens"),
        _padded(ends, capacity, 0).alias("cu_seqlens"),
        F.element_at(ends, -1).alias("total_seqlen"),
        F.size("s").alias("numseqs"),
        F.array_max(prefix).alias("max_seqlen_prefix"),
        F.array_max(causal).alias("max_seqlen_causal"),
        F.array_max(whole).alias("max_seqlen_all"),
    )
