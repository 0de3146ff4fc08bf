"""The newest version of each key at a time, by one sort over all keys and times.

Asks and versions are ordered together by (key, time) in ranges, which split a key with many
versions over several tasks. A task carries the last version forward over its rows; where a range
begins within a key, the last version of the ranges before is given to it, one row per range.

Cases: asks with a null key or time, and keys without a version by then, get none; versions with a
null key or time are left out; of versions with equal times the one with the greater order stays, and
a version counts from its own time on; repeated asks keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import settled


def _carried(keys: pa.Array, versions: pa.Array, key: pa.Array, version: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The version that stands at each row, and the key and version of the last; ``key`` and ``version`` hold the one before, if any."""
    keys, versions = pa.concat_arrays([key, keys]), pa.concat_arrays([version, versions])
    known = versions.is_valid().to_numpy(zero_copy_only=False)
    at = np.maximum.accumulate(np.where(known, np.arange(len(keys)), -1))
    place = pa.array(np.maximum(at, 0), mask=at < 0)
    own = pc.fill_null(pc.equal(keys.take(place), keys), False)
    found = versions.take(pc.if_else(own, place, pa.scalar(None, place.type)))
    last = pa.array([int(at[-1])] if at[-1] >= 0 else [], pa.int64())
    return found.slice(len(key)), keys.take(last), versions.take(last)


def asof_join(asks: DataFrame, versions: DataFrame, key: str, ask_time: str, version_time: str, order: str) -> DataFrame:
    """``asks`` with ``version``, a struct of the columns of ``versions``, null where there is none."""
    none = F.lit(None)
    given = versions.filter(F.col(key).isNotNull() & F.col(version_time).isNotNull())
    right = given.select(F.col(key).alias("k"), F.col(version_time).alias("t"), F.lit(0).alias("side"), F.col(order).alias("o"), none.alias("ask"), F.struct(*versions.columns).alias("version"))
    left = asks.select(F.col(key).alias("k"), F.col(ask_time).alias("t"), F.lit(1).alias("side"), none.cast(versions.schema[order].dataType).alias("o"), F.struct(*asks.columns).alias("ask"), none.alias("version"))
    both = right.withColumn("ask", none.cast(left.schema["ask"].dataType)).unionByName(left.withColumn("version", none.cast(right.schema["version"].dataType)))
    ordered = settled(both.repartitionByRange("k", "t", "side", "o").sortWithinPartitions("k", "t", "side", "o").withColumn("range", F.spark_partition_id()))
    # one row per range
    ends = ordered.filter("side = 0").groupBy("range").agg(F.max_by(F.struct("k", "version"), F.struct("k", "t", "o")).alias("x")).select("range", "x.k", "x.version").orderBy("range").toArrow().combine_chunks()
    numbers = ends.column("range").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, versions = batch.column("k"), batch.column("version")
            if held is None:
                before = int(np.searchsorted(numbers, batch.column("range")[0].as_py())) - 1
                held = [pa.concat_arrays([c.cast(t) for c in ends.column(n).slice(max(before, 0), int(before >= 0)).chunks] or [pa.array([], t)]) for n, t in (("k", keys.type), ("version", versions.type))]
            found, *held = _carried(keys, versions, *held)
            yield pa.RecordBatch.from_arrays([batch.column("side"), batch.column("ask"), found], ["side", "ask", "version"])

    kinds = ", ".join(f"{n} {ordered.schema[n].dataType.simpleString()}" for n in ("side", "ask", "version"))
    return ordered.drop("t", "o").mapInArrow(run, kinds).filter("side = 1").select("ask.*", "version")


def with_pinned(found: DataFrame, pinned: DataFrame, key: str, ask_time: str, version_time: str, status: str, in_force: str) -> DataFrame:
    """Where no version was found, the key's pinned one, if it is in force and began by then. ``pinned`` has one row per key."""
    held = pinned.select(F.col(key).alias("pin_key"), F.struct(*found.schema["version"].dataType.names).alias("pin"))
    good = (F.col(f"pin.{status}") == in_force) & (F.col(f"pin.{version_time}") <= F.col(ask_time))
    joined = found.join(held, F.col(key) == F.col("pin_key"), "left")
    return joined.withColumn("is_pinned", F.col("version").isNull() & F.coalesce(good, F.lit(False))).withColumn("version", F.coalesce("version", F.when(good, F.col("pin")))).drop("pin_key", "pin")
