"""Conversations into instruction/response examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import blank, strip, trim_left
from sparkloom.registry import load, query

WS = r"^\s+|\s+$"
DUCK_STRIP = "regexp_replace({0}, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')"


def duck_strip(x: str) -> str:
    return DUCK_STRIP.format(x)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role and stripped text of turns with text."""
    rows = load(spark, sf_dir, "conversations")
    return rows.filter(~blank(F.col("text"))).select("conv_id", "turn", F.lower("role").alias("role"), strip(F.col("text")).alias("text"))


def with_history(rows: DataFrame, last: int | None = None) -> DataFrame:
    """Each turn with the formatted turns before it, all or the last few, in one sort per conversation."""
    prior = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last if last else Window.unboundedPreceding, -1)
    line = F.concat(F.lit("["), "role", F.lit("]\n"), "text")
    return rows.withColumn("history", F.array_join(F.collect_list(line).over(prior), "\n\n"))


_TURNS = f"SELECT conv_id, turn, lower(role) AS role, {duck_strip('text')} AS text FROM conversations WHERE text IS NOT NULL AND length({duck_strip('text')}) > 0"


def _history_sql(frame: str) -> str:
    return f"""
WITH t AS ({_TURNS}), h AS (
  SELECT *, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS history FROM t)
"""


@query("convo_examples_full_history", _history_sql("UNBOUNDED") + "SELECT conv_id, turn, md5(history) AS instruction_md5, text AS response FROM h WHERE role = 'assistant' AND history IS NOT NULL")
def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_history(turns(spark, sf_dir)).filter((F.col("role") == "assistant") & (F.col("history") != ""))
    return rows.select("conv_id", "turn", F.md5("history").alias("instruction_md5"), F.col("text").alias("response"))


@query("convo_last_n_history", _history_sql("3") + "SELECT conv_id, turn, history AS instruction, text AS response FROM h WHERE role = 'assistant' AND history IS NOT NULL")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_history(turns(spark, sf_dir), 3).filter((F.col("role") == "assistant") & (F.col("history") != ""))
    return rows.select("conv_id", "turn", F.col("history").alias("instruction"), F.col("text").alias("response"))


@query(
    "convo_trim_left",
    _history_sql("UNBOUNDED") + "SELECT conv_id, turn, CASE WHEN length(history) > 600 THEN '[truncated]' || chr(10) || right(history, 600) ELSE history END AS instruction FROM h WHERE role = 'assistant' AND history IS NOT NULL",
)
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_history(turns(spark, sf_dir)).filter((F.col("role") == "assistant") & (F.col("history") != ""))
    return rows.select("conv_id", "turn", trim_left(F.col("history"), 600).alias("instruction"))
