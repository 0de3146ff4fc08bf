"""Readers and writers of the file formats that corpora come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a malformed line raises, or is left out where not strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_jsonl_or_text(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line: its text, and its variant value where it is JSON."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.col("value").alias("line"), F.try_parse_json("value").alias("parsed"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted line breaks and perhaps a byte order mark."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})


def with_whole_number(rows: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose text column is a whole number in a range; others are left out."""
    return rows.withColumn(column, F.expr(f"try_cast(trim(`{column}`) AS INT)")).filter(F.col(column).between(low, high))


def read_pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki dump in the main namespace that have a title and text."""
    schema = "title string, ns string, redirect struct<_title string>, revision struct<text struct<_VALUE string>>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "page").load(path)
    text = F.col("revision.text._VALUE")
    return rows.filter((F.col("ns") == "0") & F.col("title").isNotNull() & text.isNotNull()).select("title", F.col("redirect._title").alias("redirect"), text.alias("text"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """path and text of all Markdown files below root but README files."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").endswith("/README.md"))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Only the named columns, with a header and a byte order mark before it."""
    named = rows.select(*(F.col(c).alias("\ufeff" + c if k == 0 else c) for k, c in enumerate(columns)))
    named.write.csv(path, header=True, escape='"')
