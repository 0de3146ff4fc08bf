"""Shared helpers: staging in the shared folder, byte hashing, hot-key joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch on the way to Python; keeps a batch of texts small.
ARROW_ROWS = 256
ARROW_BYTES = 16_000_000
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Folders staged while recording, deleted together once nothing reads them any more."""

    _recording: ClassVar[list[Scratch]] = []

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._recording.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._recording.remove(self)

    def release(self, spark: SparkSession) -> None:
        for path in self.paths:
            delete_folder(spark, path)
        if self.paths:
            free_shuffles(spark)
        self.paths.clear()


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files of finished jobs, which Spark keeps until the driver collects their handles."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scratch in Scratch._recording:
        scratch.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def narrow(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df`` in about as many tasks as its rows are worth, so that rounds over few rows don't pay for a large input's partitions."""
    return df.coalesce(max(8, -(-rows // per_task)))


def discard(*staged: DataFrame, shuffles: bool = False) -> None:
    """Delete staged frames that nothing reads any more; with ``shuffles`` the shuffle files of finished jobs too."""
    for df in staged:
        delete_folder(df.sparkSession, df._staged_at)
        for scratch in Scratch._recording:
            if df._staged_at in scratch.paths:
                scratch.paths.remove(df._staged_at)
    if shuffles:
        free_shuffles(staged[0].sparkSession)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, longer by underscores until no column in ``taken`` has it in any case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds of Arrow batches, the same for all operators: few rows, as texts may be long, and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a task has freed to the system: a worker lives on between tasks and stages, and would hold it beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    # plans show the operator's own function
    run.__name__ = run.__qualname__ = fn.__name__
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with one row per group, of which ``size`` tells the rows.

    A group with over a thousandth of all rows is joined by broadcast: there are fewer than 1,000 of
    them, whatever the input. The rest goes by sort-merge join, where no key is large.
    """
    limit = max(n_rows // 1000, 1)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    if hot.isEmpty():
        return rows.join(cold, keys)
    marks = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(marks, keys, "left_anti").join(cold, keys))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class SpanHash:
    """Hashes of any spans of a byte array in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers = np.full(n, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers[:-1], out=self.prefix[1:])
        self.inverse = powers
        self.inverse[:] = _BASE_INV
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each data[start:end]; equal spans have equal hashes."""
        value = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix64(value + (ends - starts).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes."""
        m = len(self.prefix) - width
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.prefix[width:] - self.prefix[:m]) * self.inverse[:m])


def pack_array(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack_array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys as differences, their bytes in planes, which compress well."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pack_array(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = unpack_array(data, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_shard(rows: DataFrame, shards: int, done: Callable[[int, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call done(shard, [(block_id, packed keys, packed counts)]) for each shard of rows, and yield its batches.

    Shards are dealt over the tasks evenly; a task holds packed keys of one shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *rest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if shard != now and held:
                    yield from done(now, held)
                    held = []
                now = shard
                held.append(rest)
        if held:
            yield from done(now, held)

    return map_arrow(rows.repartition(2 * shards, "shard").sortWithinPartitions("shard", "block_id"), run, schema)
