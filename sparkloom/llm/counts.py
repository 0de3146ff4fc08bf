"""Token counts through a digest cache.

Each text has a digest; the cache maps (text digest, tokenizer digest) to a count. Only distinct
texts that the cache lacks are encoded, once each, and appended to it. The tokenizer digest is the
sha256 of the vocabulary file, so another version never answers for this one.

Defined cases: a null text counts as empty; repeated rows and null ids keep their rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import delete_folder, discard, join_groups, map_arrow, shared_dir, stage
from sparkloom.llm.units import encoder, gathered

LIMIT_TOKENS = 2048
_CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]


class CountCache:
    """Counts as Parquet files under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], _CACHE).write.mode("append").parquet(path)

    def read(self, tokenizer: str) -> DataFrame:
        return self.spark.read.schema(_CACHE).parquet(self.path).filter(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "tokenizer", "n_tokens").write.mode("append").parquet(self.path)


def _digest(column: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256))


def count_texts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """digest and n_tokens of rows with digest and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for digests, values in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(coder.counts(values), pa.int64())], ["digest", "n_tokens"])

    return map_arrow(texts.select("digest", "text"), run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = LIMIT_TOKENS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache = CountCache(spark, cache_path or f"{shared_dir(spark)}/sparkloom/counts-{uuid.uuid4().hex}")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", _digest())
    rows = stage(named.select("doc_id", "digest", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "count-rows")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    groups = stage(rows.groupBy("digest").agg(F.min(key).alias("first_id"), F.count("*").alias("rows_here")), "count-groups")
    missing = groups.join(cache.read(version), "digest", "left_anti").select("digest", "first_id")
    texts = named.withColumn("first_id", key).join(missing, ["digest", "first_id"], "left_semi")
    # rows that repeat both id and text were encoded each; one count of each digest goes into the cache
    counted = count_texts(texts, tokenizer_path).dropDuplicates(["digest"])
    cache.append(counted.withColumn("tokenizer", F.lit(version)))
    known = stage(groups.select("digest", "rows_here").join(cache.read(version), "digest"), "count-known")
    discard(groups)
    if not cache_path:
        delete_folder(spark, cache.path)
    joined = join_groups(rows, known, ["digest"], "rows_here", rows.count())
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
