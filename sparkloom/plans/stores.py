"""Prepared samples through a stored dataset: framed once, written, and read back by scan and by epoch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.dialects import ring, spell
from sparkloom.plans.frames import framed, spans, written_rows
from sparkloom.registry import load, query
from sparkloom.session import shared_folder, written
from sparkloom.sources import v1store

EPOCHS = 2


def samples_of(docs: DataFrame) -> DataFrame:
    """sample_id, inst and resp of the documents that become samples, in the order of doc_id.

    Those documents are told first and written, so that no text of another is dealt; they are framed after they are dealt.
    """
    spark = docs.sparkSession
    # framing costs more than reading, so that small inputs are dealt over all cores too
    parts = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    rows = written(spark.sql(written_rows(), documents=docs), "samples")
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return spark.sql(f"SELECT doc_id AS sample_id, inst, resp FROM ({framed(0, 'SELECT * FROM {dealt}')}) f", dealt=dealt)


def stored(spark: SparkSession, sf_dir: str) -> str:
    """A new store of all documents in the shared folder."""
    path = f"{shared_folder(spark)}/sparkloom/v1-{uuid.uuid4().hex}"
    v1store.write_store(samples_of(load(spark, sf_dir, "documents")), path)
    return path


def _digest(column: str) -> F.Column:
    return F.md5(F.array_join(column, ",")).alias(f"{column}_md5")


def _text(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


_STORED = f"SELECT s.doc_id AS sample_id, inst_start, inst_len, resp_start, resp_len, {_text('inst')} AS inst_md5, {_text('resp')} AS resp_md5 FROM ({spell(spans(1), 1)}) s JOIN ({framed(1)}) f ON f.doc_id = s.doc_id"
_PLACES = " UNION ALL ".join(f"SELECT {k} AS epoch, pos, sample_id FROM ({spell(ring('SELECT doc_id AS sample_id, 0 AS whole FROM (' + framed(1) + ') w', 'whole', 'sample_id', f'epoch{k}'), 1)}) e{k}" for k in range(EPOCHS))


@query("v1_store_scan", _STORED.replace("{documents}", "documents"))
def v1_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all samples to a store and scan it: spans and ids as they were framed."""
    rows = v1store.read_store(spark, stored(spark, sf_dir))
    return rows.select("sample_id", "inst_start", "inst_len", "resp_start", "resp_len", _digest("inst"), _digest("resp"))


@query("v1_store_epochs", f"SELECT epoch, pos, s.* FROM ({_PLACES}) p JOIN ({_STORED}) s ON s.sample_id = p.sample_id".replace("{documents}", "documents"))
def v1_store_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a store with two epochs, and gather the samples of each in its own order."""
    path = stored(spark, sf_dir)
    v1store.write_epochs(spark, path, EPOCHS)
    out = None
    for k in range(EPOCHS):
        rows = v1store.read_epoch(spark, path, k).select(F.lit(k).alias("epoch"), "pos", "sample_id", "inst_start", "inst_len", "resp_start", "resp_len", _digest("inst"), _digest("resp"))
        out = rows if out is None else out.unionByName(rows)
    return out
