"""Sources that are folders, logs or nested JSON, and the sinks that corpora are written to."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import settled

SUFFIXES = (".jsonl", ".parquet")


def resolve_inputs(inputs: Iterable[str], suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Sorted files of files, folders (with all below them) and patterns; only the listed suffixes count.

    A file named outright with another suffix is an error, as is an input without any file.
    """
    found: set[str] = set()
    for given in inputs:
        if os.path.isfile(given):
            if not given.endswith(suffixes):
                raise ValueError(f"{given} has none of the suffixes {', '.join(suffixes)}")
            own = [given]
        elif os.path.isdir(given):
            own = [os.path.join(folder, name) for folder, _, names in os.walk(given) for name in names if name.endswith(suffixes)]
        else:
            own = [x for x in glob.glob(given, recursive=True) if os.path.isfile(x) and x.endswith(suffixes)]
        if not own:
            raise FileNotFoundError(f"{given} names no input file")
        found.update(own)
    return sorted(found)


def read_inputs(spark: SparkSession, inputs: Iterable[str], schema: str, cap: int | None = None) -> DataFrame:
    """Rows of all input files as one table with ``file``, at most ``cap`` rows of each in the file's order."""
    files = resolve_inputs(inputs)
    parts = []
    for suffix, form in ((".jsonl", "json"), (".parquet", "parquet")):
        own = [x for x in files if x.endswith(suffix)]
        if own:
            reader = spark.read.schema(schema).option("mode", "FAILFAST") if form == "json" else spark.read.schema(schema)
            rows = reader.format(form).load(own)
            # a block's start and the row's place in it give the file's order
            parts.append(rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    if cap is not None:
        order = Window.partitionBy("file").orderBy("_block", "_place")
        out = out.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")
    return out.drop("_block", "_place")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role and text of a JSON array of conversations."""
    schema = "id string, conversations array<struct<`from` string, value string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    turns = rows.select(F.col("id").alias("conv_id"), F.posexplode("conversations").alias("turn", "m"))
    return turns.select("conv_id", "turn", F.col("m.from").alias("role"), F.col("m.value").alias("text"))


def read_session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of session logs: a file is a conversation, named by its last "session" event, else by its file."""
    schema = "type string, id string, message struct<role string, content string>"
    rows = spark.read.schema(schema).json(folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    named = rows.filter("type = 'session'").groupBy("file").agg(F.max_by("id", F.struct("_block", "_place")).alias("session"))
    turns = rows.filter("type = 'message' AND message.content IS NOT NULL")
    order = Window.partitionBy("file").orderBy("_block", "_place")
    turns = turns.withColumn("turn", F.row_number().over(order) - 1).join(named, "file", "left")
    return turns.select(F.coalesce("session", F.regexp_replace("file", r"\.jsonl$", "")).alias("conv_id"), "turn", F.col("message.role").alias("role"), F.col("message.content").alias("text"))


#: Datasets by name: format, path below a root, and split.
Registry = dict[str, tuple[str, str]]


def read_dataset(spark: SparkSession, root: str, registry: Registry, name: str, split: str = "train", cap: int | None = None) -> DataFrame:
    """A registered dataset's split; ``cap`` rows of it at most."""
    form, path = registry[name]
    rows = spark.read.format(form).load(f"{root}/{path}/{split}")
    return rows.limit(cap) if cap is not None else rows


def task_bases(tasks: DataFrame) -> DataFrame:
    """task, n_tokens and base, the tokens of all tasks before it by name; one row a task folder."""
    order = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return tasks.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))


def json_strings(rows: DataFrame, column: str) -> DataFrame:
    """Every non-blank string inside a JSON column, stripped: values of objects and items of lists, at any depth."""

    def strings(x) -> Iterator[str]:
        held = [x]
        while held:
            now = held.pop()
            if isinstance(now, dict):
                held.extend(reversed(list(now.values())))
            elif isinstance(now, list):
                held.extend(reversed(now))
            elif isinstance(now, str) and now.strip():
                yield now.strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                try:
                    out += list(strings(json.loads(line or "null")))
                except ValueError:
                    out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    return rows.select(column).mapInArrow(run, "text string")


def sample_tree(spark: SparkSession, root: str, most_bytes: int, pattern: str = "*.{md,txt,json,jsonl}") -> DataFrame:
    """path and text of files in path order until most_bytes are taken; the last one is cut. Dot files are junk."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))
    files = files.filter(~F.col("path").rlike(r"/\.[^/]*$"))
    # sizes alone are summed in order: a row a file
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("path", "size").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).filter(F.col("before") < most_bytes)
    cut = F.decode(F.substring(F.encode("text", "UTF-8"), 1, F.lit(most_bytes) - F.col("before")), "UTF-8")
    return files.drop("size").join(before, "path").select("path", F.when(F.col("before") + F.col("size") > most_bytes, cut).otherwise(F.col("text")).alias("text"))


def folder_sizes(spark: SparkSession, root: str) -> DataFrame:
    """files and bytes of each folder right below root; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    below = F.regexp_extract("path", r"/" + os.path.basename(root.rstrip("/")) + r"/([^/]+)", 1)
    return rows.groupBy(below.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def prefix_config(spark: SparkSession, path: str) -> DataFrame:
    """ord, prefix, max_per_file, long_context and repeat of a YAML list of flat mappings."""
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()  # a configuration file
    found: list[dict[str, str]] = []
    for line in lines:
        name, _, value = line.strip().removeprefix("- ").partition(":")
        if line.strip().startswith("- "):
            found.append({})
        if found and value.strip():
            found[-1][name.strip()] = value.strip().strip("\"'")
    rows = [(k, x["prefix"], int(x["max_per_file"]) if "max_per_file" in x else None, x.get("long_context", "drop"), int(x.get("repeat", 1))) for k, x in enumerate(found)]
    return spark.createDataFrame(rows, "ord int, prefix string, max_per_file int, long_context string, repeat int")


def entity_index(spark: SparkSession, root: str, preferred: list[str]) -> DataFrame:
    """entity (a folder) and its file: the first preferred name that is there, else the first Markdown file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).select("path")
    parts = files.select("path", F.element_at(F.split("path", "/"), -2).alias("entity"), F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("name")), F.lit(0)), F.lit(len(preferred) + 1))
    return parts.groupBy("entity").agg(F.min_by("path", F.struct(rank, "name")).alias("path"))


def holding_terms(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose text holds one of some literal terms; each is a predicate of the scan."""
    found = F.lit(False)
    for term in terms:
        found = found | F.col(column).contains(term)
    return rows.filter(found)


def parse_nested(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose JSON string column parses, with its value as a struct; others are left out."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return rows.withColumn(column, parsed).filter(F.col(column).isNotNull() & F.to_json(F.col(column)).isNotNull() & (F.to_json(F.col(column)) != "{}"))


def write_jsonl_with_stats(rows: DataFrame, path: str) -> dict:
    """Write JSON lines, and beside them rows, bytes and counts by source as ``path``.stats.json."""
    spark = rows.sparkSession
    rows.write.json(path)
    lines = spark.read.text(path)
    own = lines.groupBy(F.get_json_object("value", "$.source").alias("source")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    found = own.orderBy("source").collect()  # a row a source
    stats = {"rows": sum(x["rows"] for x in found), "bytes": sum(x["bytes"] for x in found), "by_source": {x["source"] or "": x["rows"] for x in found}}
    spark.createDataFrame([(json.dumps(stats, sort_keys=True),)], "value string").coalesce(1).write.text(path + ".stats.json")
    return stats


def write_capped_jsonl(rows: DataFrame, path: str, order: str, cap: int, first_row: bool = False) -> None:
    """Write JSON lines in an order up to a number of bytes: what would exceed it ends the file.

    With ``first_row`` the first line is written whatever its size. ``order`` is of any type, nulls
    first; equal keys go by their lines. Lines are sorted by ranges and summed within each range, so that
    no task holds all lines; the ranges' totals are one row per partition of the sort.
    """
    lines = rows.select(F.col(order).alias("o"), F.to_json(F.struct("*")).alias("value")).withColumn("n", F.octet_length("value") + 1)
    placed = settled(lines.orderBy("o", "value").withColumn("at", F.monotonically_increasing_id()).withColumn("bk", F.shiftrightunsigned("at", 33)))
    sums = placed.groupBy("bk").agg(F.sum("n").alias("v"))
    bases = sums.withColumn("base", F.sum("v").over(Window.orderBy("bk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("v")).drop("v")
    ends = placed.join(bases, "bk")
    ends = ends.withColumn("end", F.col("base") + F.sum("n").over(Window.partitionBy("bk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    kept = ends.filter((F.col("end") <= cap) | (F.lit(first_row) & (F.col("end") == F.col("n"))))
    kept.orderBy("at").select("value").write.text(path)


def write_messages(rows: DataFrame, path: str) -> None:
    """Chat messages as JSON lines, from instruction and response (and system, where there is one)."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = [turn("user", F.col("instruction")), turn("assistant", F.col("response"))]
    if "system" in rows.columns:
        turns.insert(0, turn("system", F.col("system")))
    rows.select(F.array(*turns).alias("messages")).write.json(path)


def write_pages(rows: DataFrame, path: str) -> None:
    """One text file for each name, from columns name and body."""
    rows.select("body", "name").repartition("name").write.partitionBy("name").text(path)
