"""A stored token dataset: flat files of ids, an index of samples, and epochs over them.

The format "v1store" is a Python data source. A writing task puts the ids of its samples into one
flat file of little-endian 32-bit numbers, and their lengths into another; the commit lists the files
in the order of the tasks with the number of ids before each, so that a sample's place in the whole
is its file's base plus its place there. Files of failed or repeated tasks are never listed. A reading
task takes a range of samples of one file. An epoch is a table of spans in the order of a hash; its
ids are gathered by a task per range of places, which reads files forward.

Cases: samples may be empty on either side; a store without samples has files of no ids; a null
sample id comes back as null.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sparkloom.plans.dialects import ring, spell
from sparkloom.session import written

#: Samples that a reading task takes, and that a batch holds.
READ_SAMPLES, BATCH_SAMPLES = 65_536, 1024
_NULL_ID = -(1 << 63)
_SPANS = "sample_id long, inst_start long, inst_len long, resp_start long, resp_len long"
SCHEMA = _SPANS + ", inst array<int>, resp array<int>"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (pafs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its number, the name of its files, samples, ids, and the longest sample."""

    number: int
    name: str
    samples: int
    tokens: int
    longest: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, options: dict[str, str]):
        self.path, self.overwrite, self.options = path, overwrite, options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        store, root = open_store(self.path)
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/tokens", recursive=True)
        samples = tokens = longest = 0
        with store.open_output_stream(f"{root}/tokens/{name}.ids") as ids, store.open_output_stream(f"{root}/tokens/{name}.idx") as index:
            for batch in iterator:
                keys = batch.column("sample_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                inst, resp = (batch.column(c) for c in ("inst", "resp"))
                sizes = np.stack([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (inst, resp)], axis=1).astype(np.int64)
                # a sample's instruction, then its response
                both = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (inst, resp)])
                ends = np.cumsum(sizes, axis=0)
                begins = ends - sizes + [0, int(ends[-1, 0]) if len(ends) else 0]
                order = np.repeat((begins - (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 2)).ravel(), sizes.ravel()) + np.arange(int(sizes.sum()))
                ids.write(np.ascontiguousarray(both[order], "<i4").tobytes())
                index.write(np.ascontiguousarray(np.column_stack([keys, sizes]), "<i8").tobytes())
                samples, tokens = samples + len(keys), tokens + int(sizes.sum())
                longest = max(longest, int(sizes.sum(axis=1).max(initial=0)))
        return Part(number, name, samples, tokens, longest)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = open_store(self.path)
        found = [m for m in messages if m is not None]
        old = [] if self.overwrite or not _exists(store, f"{root}/metadata.json") else read_metadata(self.path)["parts"]
        parts, base = list(old), sum(p["tokens"] for p in old)
        for part in sorted(found, key=lambda p: p.number):
            parts.append(asdict(part) | {"base": base})
            base += part.tokens
        given = json.loads(self.options.get("tokenizer_info", "{}"))
        longest = max((p["longest"] for p in parts), default=0)
        if longest >= int(self.options.get("context_size", longest + 1)):
            self.abort(messages)
            raise ValueError(f"the longest sample has {longest} ids, the context only {self.options['context_size']}")
        meta = {"tokenizer_info": given, "vocab_size": None, "max_seq_len": int(self.options.get("context_size", longest)), "total_length": base, "parts": parts}
        with store.open_output_stream(f"{root}/metadata.json") as out:
            out.write(json.dumps(meta).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, root = open_store(self.path)
        for part in messages:
            for end in ("ids", "idx") if part is not None else ():
                if _exists(store, f"{root}/tokens/{part.name}.{end}"):
                    store.delete_file(f"{root}/tokens/{part.name}.{end}")


def _exists(store: pafs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != pafs.FileType.NotFound


def read_metadata(path: str) -> dict:
    store, root = open_store(path)
    with store.open_input_stream(f"{root}/metadata.json") as f:
        return json.loads(f.read())


@dataclass
class _Range(InputPartition):
    name: str
    base: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[_Range]:
        out = []
        for part in read_metadata(self.path)["parts"]:
            out += [_Range(part["name"], part["base"], k, min(k + READ_SAMPLES, part["samples"])) for k in range(0, part["samples"], READ_SAMPLES)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        store, root = open_store(self.path)
        with store.open_input_file(f"{root}/tokens/{partition.name}.idx") as index, store.open_input_file(f"{root}/tokens/{partition.name}.ids") as ids:
            at, done = 0, 0
            while done < partition.last:  # lengths before the range are read, their ids are not
                rows = np.frombuffer(index.read_at(24 * min(BATCH_SAMPLES, (partition.first if done < partition.first else partition.last) - done), 24 * done), "<i8").reshape(-1, 3)
                done += len(rows)
                sizes = rows[:, 1:]
                if done > partition.first:
                    ends = at + np.cumsum(sizes.ravel()).reshape(-1, 2)
                    begins = partition.base + ends - sizes
                    columns = [pa.array(rows[:, 0], mask=rows[:, 0] == _NULL_ID), *(pa.array(np.ascontiguousarray(x)) for x in (begins[:, 0], sizes[:, 0], begins[:, 1], sizes[:, 1]))]
                    if self.with_ids:
                        values = np.frombuffer(ids.read_at(4 * int(sizes.sum()), 4 * at), "<i4")
                        bounds = np.concatenate([[0], np.cumsum(sizes.ravel())]).astype(np.int64)
                        columns += [_spans_of(values, bounds[k:-1:2], sizes[:, k]) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in (SCHEMA if self.with_ids else _SPANS).split(", ")])
                at += int(sizes.sum())


def _spans_of(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list column of values[begin : begin + size]."""
    ends = np.cumsum(sizes)
    place = np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[place]))


class V1Store(DataSource):
    """``spark.read.format("v1store").load(path)``; the option ids=false gives spans alone."""

    @classmethod
    def name(cls) -> str:
        return "v1store"

    def schema(self) -> str:
        return SCHEMA if self._ids() else _SPANS

    def _ids(self) -> bool:
        return self.options.get("ids", "true").lower() == "true"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"], self._ids())

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options["path"], overwrite, dict(self.options))


def write_store(samples: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Write sample_id, inst and resp in the order of partitions and of the rows in them."""
    samples.sparkSession.dataSource.register(V1Store)
    rows = samples.select(F.col("sample_id").cast("long").alias("sample_id"), *(F.coalesce(F.col(c).cast("array<int>"), F.array().cast("array<int>")).alias(c) for c in ("inst", "resp")))
    rows.write.format("v1store").options(**options).mode(mode).save(path)


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Samples of a store with their spans, and with their ids."""
    spark.dataSource.register(V1Store)
    return spark.read.format("v1store").option("ids", str(ids).lower()).load(path)


def write_epochs(spark: SparkSession, path: str, epochs: int, seed: str = "epoch") -> None:
    """For each epoch the spans of all samples in the order of a hash, as Parquet under the store."""
    # a ring reads its rows twice, and so does a deal by ranges
    spans = written(read_store(spark, path, ids=False).withColumn("whole", F.lit(0)), "spans")
    for k in range(epochs):
        placed = written(spark.sql(spell(ring("SELECT * FROM {spans}", "whole", "sample_id", f"{seed}{k}"), 0), spans=spans), "places")
        placed.select("pos", *(x.split()[0] for x in _SPANS.split(", "))).repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/epoch_{k}")


def gather(spans: DataFrame, path: str) -> DataFrame:
    """``spans`` with the ids of both their spans; a task reads its range of the store forward.

    The list of parts goes to the tasks: one entry per file, as the commit wrote it.
    """
    parts = [p for p in read_metadata(path)["parts"] if p["tokens"]]
    bases, names = [p["base"] for p in parts], [p["name"] for p in parts]
    columns = spans.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        held, file = -1, None
        for batch in batches:
            lists: dict[str, list[np.ndarray]] = {"inst": [], "resp": []}
            for key, out in lists.items():
                for start, size in zip(batch.column(f"{key}_start").to_pylist(), batch.column(f"{key}_len").to_pylist(), strict=True):
                    k = bisect.bisect_right(bases, start) - 1
                    if size and k != held:
                        if file is not None:
                            file.close()
                        held, file = k, store.open_input_file(f"{root}/tokens/{names[k]}.ids")
                    out.append(np.frombuffer(file.read_at(4 * size, 4 * (start - bases[k])), "<i4") if size else np.zeros(0, "<i4"))
            found = [_spans_of(np.concatenate(x) if x else np.zeros(0, "<i4"), np.cumsum(n := np.array([len(y) for y in x], np.int64)) - n, n) for x in lists.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*columns, "inst", "resp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)
    return spans.repartitionByRange("inst_start").sortWithinPartitions("inst_start").mapInArrow(run, f"{kinds}, inst array<int>, resp array<int>")


def read_epoch(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """Samples of one epoch with their places in it and their ids; sort by pos where order counts."""
    return gather(spark.read.parquet(f"{path}/epoch_{epoch}"), path)
