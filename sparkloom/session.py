"""Session builder with the settings the engine is tested under."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that Python takes of an Arrow batch at once; Spark's own batches have 10,000 rows.
SLICE_ROWS, SLICE_BYTES = 256, 4_000_000


def build_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and skew handling on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lineage ends there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder, for plans that read it several times."""
    path = f"{shared_folder(df.sparkSession)}/sparkloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches by views of SLICE_ROWS at most, and of about SLICE_BYTES, so that Python objects are made of few rows at once."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            # long texts that stand together are halved further
            todo = [part]
            while todo:
                part = todo.pop()
                if part.num_rows > 1 and part.nbytes > 2 * SLICE_BYTES:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
