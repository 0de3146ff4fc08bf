"""Queries over operators that need Arrow functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import chunking, multipack, similar, tensors
from sparkloom.plans.stores import samples_of
from sparkloom.registry import load, query
from sparkloom.session import settled

#: Shards that the packer's queries deal samples into at every size, and ids in a rank's sequence.
SHARDS, TOKENS = 16, 1024


def _chunks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = chunking.chunks(load(spark, sf_dir, "documents"), kind, 1200, 160)
    return rows.select("doc_id", "chunk_index", F.length("body").alias("n"), F.md5("body").alias("h"))


@query("chunk_paragraph")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "paragraph")


@query("chunk_heading")
def chunk_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "heading")


@query("chunk_newline")
def chunk_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "newline")


@query("lpt_pack")
def lpt_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples are at most as long as a rank's sequence: longer documents are taken as cut to it, as sample_policies does."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.least(F.size(F.split("text", " ")), F.lit(2048)).alias("length"))
    return multipack.pack(rows, capacity=2048, ranks=4, shards=SHARDS)


@query("packed_tensors")
def packed_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with real ids, packed for two ranks, as the tensors of each rank's sequence; arrays by their md5."""
    samples = settled(samples_of(load(spark, sf_dir, "documents")))
    lengths = samples.select("sample_id", (F.size("inst") + F.size("resp") - 1).alias("length"))
    rows = tensors.batch_tensors(multipack.pack(lengths, TOKENS, ranks=2, shards=SHARDS), samples, TOKENS)
    return rows.select(*(F.md5(F.array_join(c, ",")).alias(c) if kind.startswith("array") else c for c, kind in rows.dtypes))


@query("decontaminate_ratio")
def decontaminate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.best_ratio(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("decontaminate_containment", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0")
def decontaminate_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.containing(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
