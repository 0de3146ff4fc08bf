"""ASCII-lowered words of texts, on their UTF-8 bytes.

bytes.lower() changes A-Z only, and every byte of a character beyond ASCII is above 0x7F, so these
byte patterns find the same runs as character classes without the ASCII signs do.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LETTERS = re.compile(rb"[a-z\x80-\xff]+")
ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def numbering() -> defaultdict[bytes, int]:
    """A dict that numbers its keys from 0 as they are first asked for."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def strings(found: list[bytes]) -> pa.Array:
    return pa.array(found, pa.binary()).cast(pa.string())


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what runs inside, as rows of single terms are short; restored after."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
