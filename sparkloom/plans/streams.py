"""Streams over the events as they stand, from files to a shared folder, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.registry import query
from sparkloom.session import shared_folder
from sparkloom.streaming.events import drain, read_events
from sparkloom.streaming.watch import stable_items

REST_HOURS = 12


@query(
    "stream_items_at_rest",
    f"""WITH e AS (SELECT user_id, ts, event_id, length(event_type) AS size, max(ts) OVER () AS seen FROM events),
c AS (SELECT *, size IS DISTINCT FROM lag(size) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new FROM e),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
s AS (SELECT user_id, island, any_value(size) AS size, min(ts) AS since, any_value(seen) AS seen FROM i GROUP BY user_id, island),
u AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY user_id ORDER BY island), seen) AS until FROM s)
SELECT user_id, CAST(arg_min(size, island) AS BIGINT) AS size, date_trunc('second', min(since)) AS since FROM u WHERE epoch_ms(until) - epoch_ms(since) >= {REST_HOURS * 3_600_000} GROUP BY user_id""",
)
def stream_items_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time that each user's events keep one length of type for twelve hours, by timers on the events' own time."""
    # a pattern, as a stream takes a single file by no other name
    seen = read_events(spark, f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("item"), F.length("event_type").cast("long").alias("size"), F.array().cast("array<string>").alias("files"), F.col("ts").alias("seen_at"))
    path = f"{shared_folder(spark)}/sparkloom/rest-{uuid.uuid4().hex}"
    drain(stable_items(seen, REST_HOURS * 3600), f"{path}/out", f"{path}/mark")
    rows = spark.read.schema("item long, size long, since timestamp").parquet(f"{path}/out")
    return rows.select(F.col("item").alias("user_id"), "size", F.date_trunc("second", "since").alias("since"))
