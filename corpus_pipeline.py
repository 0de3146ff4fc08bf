"""Toxicity filter, exact and near deduplication, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs. All but the last return the columns of docs.
When a stage begins, its docs have been written, so what earlier stages staged on the way is deleted:
one pipeline runs in a driver at a time.

Defined cases, of all stages: a null text counts as empty; rows with null ids are kept like others;
repeated rows end as one at exact dedup; texts are taken whole whatever their length; an empty table
gives no rows; further columns are kept, whatever their names, but by packing, which ignores them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, read_table, stage
from sparkloom.llm.entry import vocabulary
from sparkloom.llm.exact import kept_rows
from sparkloom.llm.near import one_of_each
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.repeats import PASSAGE_BYTES, without_repeats
from sparkloom.llm.toxicity import drop_toxic

#: Units that a worker remembers when it packs, fewer than alone, as executors have grown in the stages before.
MEMO_UNITS = 200_000

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCRATCH = Scratch()


def step(fn: Step) -> Step:
    """A stage that deletes what the stage before it staged, and records what it stages."""

    @functools.wraps(fn)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _SCRATCH.release(spark)
        with _SCRATCH:
            return fn(spark, docs, sf_dir)

    return run_step


@step
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't reject."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@step
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return kept_rows(docs)


@step
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


@step
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE_BYTES that repeat; those of which nothing is left go, those without text before stay."""
    full = F.coalesce(F.length("text"), F.lit(0)) > 0
    return without_repeats(docs.filter(full), PASSAGE_BYTES).filter(full).unionByName(docs.filter(~full))


@step
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), memo_units=MEMO_UNITS)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("packing", packing)]

#: Trained trees, sampled hashes and tokenizers are beyond SQL; tests hold the exact, near and suffix stages and packing against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
