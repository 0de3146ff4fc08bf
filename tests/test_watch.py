"""Watched items over several triggers and restarts from the checkpoint."""

import datetime as dt
import time

from sparkloom.streaming import watch
from sparkloom.streaming.events import drain

ZERO = dt.datetime(2024, 1, 1)


def at(seconds):
    return ZERO + dt.timedelta(seconds=seconds)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


SIZES = "item string, size long, files array<string>, seen_at timestamp"
STATES = "item string, state string, seen_at timestamp"


def test_items_go_on_once_when_whole_and_at_rest(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def step(*rows):
        """One run of the stream, from the checkpoint of the one before."""
        put(spark, folder, [(i, n, f, at(t)) for i, n, f, t in rows], SIZES)
        stream = watch.stable_items(spark.readStream.schema(SIZES).parquet(folder), 60, ("meta", "data"))
        drain(stream, out, mark)
        return sorted((r.item, r.size, (r.since - ZERO).total_seconds()) for r in spark.read.schema("item string, size long, since timestamp").parquet(out).collect())

    assert step(("a", 5, ["meta", "data"], 0), ("b", 5, ["meta"], 0), ("c", 1, ["meta", "data"], 0), ("c", 2, None, 30)) == []
    # a has rested since 0; c grew at 30 and again at 80; b lacks a file
    assert step(("c", 3, None, 80), ("z", 0, None, 100)) == [("a", 5, 0.0)]
    # b's file comes late, its size unchanged: it goes on with the sighting; a is heard of again and stays done
    assert step(("b", 5, ["data"], 130), ("a", 9, None, 131)) == [("a", 5, 0.0), ("b", 5, 0.0)]
    assert step(("z", 0, None, 400)) == [("a", 5, 0.0), ("b", 5, 0.0), ("c", 3, 80.0)]
    assert step(("c", 3, None, 600), ("z", 0, None, 900)) == [("a", 5, 0.0), ("b", 5, 0.0), ("c", 3, 80.0)]


def test_one_restart_after_the_grace_time(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def step(*rows):
        put(spark, folder, [(i, s, at(t)) for i, s, t in rows], STATES)
        drain(watch.grace_restarts(spark.readStream.schema(STATES).parquet(folder), 60), out, mark)
        return sorted((r.item, (r.ended - ZERO).total_seconds()) for r in spark.read.schema("item string, ended timestamp").parquet(out).collect())

    assert step(("a", "ended", 0), ("b", "ended", 0), ("b", "active", 20), ("c", "ended", 5), ("c", "running", 40)) == []
    assert step(("z", "running", 200)) == [("a", 0.0)]
    # c ends again; a has had its restart
    assert step(("c", "ended", 210), ("a", "ended", 220), ("z", "running", 500)) == [("a", 0.0), ("c", 210.0)]


def test_the_clock_sets_an_item_free(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, folder, [("a", 5, ["data"], at(0))], SIZES)
    stream = watch.stable_items(spark.readStream.schema(SIZES).parquet(folder), 2, ("data",), by_event_time=False)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", mark).trigger(processingTime="1 second").start(out)
    end = time.time() + 90
    while time.time() < end and not spark.read.schema("item string, size long, since timestamp").parquet(out).count() if (tmp_path / "out").exists() else time.time() < end:
        time.sleep(1)
    query.stop()
    assert [r.item for r in spark.read.parquet(out).collect()] == ["a"]
