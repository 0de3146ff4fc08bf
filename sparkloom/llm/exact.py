"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text: the id that stays and
the number of rows. New data is reduced to one row per digest, anti-joined with the index by
sort-merge, and what is new is appended.

Defined cases: a null text counts as empty; of equal texts the row with the largest doc_id stays,
null ids count least, and of rows that repeat id and text exactly one stays; against a named index, a
text of an earlier batch stays there and drops here; an empty table gives no rows; a text of any length
is one digest; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, fresh, join_groups, stage

#: Buckets of a new index: at least so many, and one for so many rows of its first batch.
BUCKETS, BUCKET_ROWS = 16, 2_000_000
_COLUMNS = "digest binary, keep struct<doc_id:bigint,rid:bigint>, group_size bigint, batch string"


class DigestIndex:
    """A bucketed, sorted table of digests in the session's warehouse, which knows its number of buckets."""

    def __init__(self, spark: SparkSession, table: str, rows: int = 0):
        self.spark, self.table = spark, table
        self.buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
        if spark.catalog.tableExists(table):
            self.buckets = int(spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()["data_type"])
        else:
            self.append(spark.createDataFrame([], _COLUMNS))

    def append(self, groups: DataFrame) -> None:
        groups.select("digest", "keep", "group_size", "batch").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index doesn't have."""
        return groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")


def digests(docs: DataFrame) -> DataFrame:
    """rid, doc_id and digest of each row; rid tells repeated rows apart and is fixed once staged."""
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
    )


def dedup_rows(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Decide for staged rows of digests(), a batch; new digests go into the index with the batch's name.

    Digests that an earlier batch brought drop all their rows here, whatever their ids.
    """
    batch = uuid.uuid4().hex
    groups = rows.groupBy("digest").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "rid")).alias("keep"), F.count("*").alias("group_size"))
    groups = stage(groups.withColumn("batch", F.lit(batch)), "digest-groups")
    index.append(index.fresh(groups))
    sizes = groups.select("digest", F.col("group_size").alias("rows_here"))
    known = stage(sizes.join(index.read(), "digest"), "digest-known")
    discard(groups)
    joined = join_groups(rows, known, ["digest"], "rows_here", rows.count())
    return joined.select(
        "rid",
        "doc_id",
        F.when(F.col("keep.doc_id") > -(1 << 63), F.col("keep.doc_id")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("batch") == batch) & (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, table: str | None = None) -> DataFrame:
    """Decisions for every row of docs; with no table named, against a new and empty index."""
    spark = docs.sparkSession
    rows = stage(digests(docs), "digests")
    index = DigestIndex(spark, table or f"digest_index_{uuid.uuid4().hex}", rows.count())
    out = dedup_rows(rows, index).drop("rid")
    if not table:
        spark.sql(f"DROP TABLE {index.table}")
    return out


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns; rows that repeat id and text count once."""
    digest, at = fresh("digest", docs.columns), fresh("at", docs.columns)
    low = F.lit(-(1 << 63))
    rows = exact_dedup(docs).filter("kept").select(F.unhex("text_sha256").alias(digest), F.coalesce("doc_id", low).alias(at))
    marked = docs.withColumns({digest: F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), at: F.coalesce(F.col("doc_id").cast("long"), low)})
    return marked.join(rows, [digest, at], "left_semi").dropDuplicates([digest, at]).select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
