"""Conversations as texts with headings, their sections, and training rows of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.sections import section_rows, task_rows
from sparkloom.registry import load, query


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text of each conversation: its name, then each turn under its role; every ninth turn is deleted."""
    turns = load(spark, sf_dir, "conversations").filter("text is not null")
    head = F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.when(F.pmod("turn", F.lit(9)) == 8, F.lit(" (deleted)")).otherwise(F.lit("")))
    rows = turns.select("conv_id", "turn", F.concat_ws("\n", head, F.regexp_replace("text", r"(?m)^#+", "")).alias("body"))
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), "\n").alias("body"))
    return texts.select("conv_id", F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n"), "body").alias("text"))


_BODY = r"trim(regexp_replace(text, '(?m)^#+', '', 'g'), chr(10) || chr(32) || chr(9) || chr(13))"


@query(
    "outline_sections",
    f"""WITH t AS (SELECT conv_id, turn, role, {_BODY} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, CAST(r + 1 AS INTEGER) AS section, 2 AS level, 1 AS parent, role || ' ' || turn AS title, md5(body) AS content_md5 FROM t WHERE turn % 9 <> 8
UNION ALL SELECT DISTINCT conv_id, 1, 1, NULL, 'Conversation ' || conv_id, md5('') FROM t""",
)
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section tree of every conversation's text."""
    tree = section_rows(outlines(spark, sf_dir), "conv_id", "text", deleted="(deleted)")
    return tree.select("conv_id", "section", "level", "parent", "title", F.md5("content").alias("content_md5"))


@query("outline_tasks")
def outline_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction, summary and section rows of every conversation's text."""
    tree = section_rows(outlines(spark, sf_dir), "conv_id", "text", deleted="(deleted)")
    return task_rows(tree, "conv_id", "assistant", "system")
