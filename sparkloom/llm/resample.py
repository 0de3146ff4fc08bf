"""Importance resampling of documents towards a target text set, by hashed word n-grams.

A task turns a block of texts into a dictionary of the block's distinct features and, per document,
how often it holds each (numbers into that dictionary). Blocks are written once. The block
dictionaries are added up to one global dictionary of distinct strings, each of which is hashed
once; buckets are summed from it. A bucket's gain is the log ratio of its share in the target and in
the documents. Gains go back by a join of the distinct strings of each block, so that one row per
block and string is shuffled, not one per document and string, and each block then sums its own
documents. Of the long enough documents, those with the highest weight plus Gumbel noise are drawn,
which draws without replacement in proportion to exp(weight / 1000).

Defined cases: a null text counts as empty, without features and with weight 0; a null id counts as
the empty string in the noise; repeated rows and ids keep their rows; equal scores go to the smaller
doc_id, null ids last, then to the earlier row; an empty target gives gains from the documents
alone; an empty table gives no rows; a text of any length is taken whole; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import map_arrow, pack_array, stage, unpack_array
from sparkloom.llm.words import ALNUM, batch_rows, numbering, strings, text_bytes

BUCKETS = 10_000
BLOCK_BYTES = 8_000_000
#: Gains and noise are floors of thousandths of a nat.
SCALE = 1000

_BLOCKS = "block long, doc_ids array<long>, words array<long>, sizes binary, numbers binary, counts binary, features array<string>, totals array<long>"
_WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def grams(words: list[bytes], shortest: int, longest: int) -> list[bytes]:
    """All runs of ``shortest`` to ``longest`` consecutive words, joined by one space, repeats kept."""
    out: list[bytes] = []
    for n in range(shortest, longest + 1):
        out += words if n == 1 else [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return out


class _Block:
    """Feature counts of a block's documents, as numbers into the block's dictionary."""

    def __init__(self, rid: int):
        self.rid, self.size = rid, 0
        self.names = numbering()
        self.doc_ids: list[int | None] = []
        self.words: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, raw: bytes, shortest: int, longest: int) -> None:
        words = ALNUM.findall(raw.lower())
        found = grams(words, shortest, longest)
        numbers, counts = np.unique(np.fromiter(map(self.names.__getitem__, found), np.int32, len(found)), return_counts=True)
        self.doc_ids.append(doc_id)
        self.words.append(len(words))
        self.numbers.append(numbers)
        self.counts.append(counts.astype(np.int32))
        self.size += len(raw)

    def row(self) -> pa.RecordBatch:
        numbers, counts = np.concatenate(self.numbers), np.concatenate(self.counts)
        totals = np.bincount(numbers, counts, len(self.names)).astype(np.int64)
        packed = [pack_array(x) for x in (np.array([len(x) for x in self.numbers], np.int32), numbers, counts)]

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = [pa.array([self.rid], pa.int64()), one(pa.array(self.doc_ids, pa.int64())), one(pa.array(self.words, pa.int64()))]
        columns += [pa.array([x], pa.binary()) for x in packed]
        columns += [one(strings(list(self.names))), one(pa.array(totals))]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "words", "sizes", "numbers", "counts", "features", "totals"])


def feature_blocks(docs: DataFrame, key: str, shortest: int, longest: int) -> DataFrame:
    """One row per block of about BLOCK_BYTES of text, its documents' feature counts packed. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for rid, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = block or _Block(rid)
                block.add(doc_id, raw, shortest, longest)
                if block.size >= BLOCK_BYTES or len(block.words) >= BLOCK_BYTES // 16:
                    yield block.row()
                    block = None
        if block:
            yield block.row()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), text_bytes().alias("text"))
    return stage(map_arrow(rows, run, _BLOCKS), "feature-blocks")


def _exploded(blocks: DataFrame) -> DataFrame:
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("features", "totals")).alias("number", "x"))
    return pairs.select("block", "number", F.col("x.features").alias("feature"), F.col("x.totals").alias("total"))


def dictionary(blocks: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, bucket, here, there: each distinct string of either side once, hashed once. Staged."""
    both = _exploded(blocks).select("feature", F.col("total").alias("here"), F.lit(0).cast("long").alias("there"))
    both = both.unionAll(_exploded(target).select("feature", F.lit(0).cast("long"), "total"))
    counted = both.groupBy("feature").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))
    return stage(counted.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int")), "feature-dictionary")


def bucket_gains(known: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: ``buckets`` rows at most, which bounds the broadcast."""
    sums = known.groupBy("bucket").agg(F.sum("here").cast("double").alias("s"), F.sum("there").cast("double").alias("t"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return sums.crossJoin(F.broadcast(total)).select("bucket", F.floor(SCALE * F.log(ratio)).cast("int").alias("gain"))  # one row of totals


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids, words, sizes, numbers, counts, gains = (batch.column(c)[k] for c in ("doc_ids", "words", "sizes", "numbers", "counts", "gains"))
            sizes, numbers, counts = (unpack_array(x.as_py(), "i4") for x in (sizes, numbers, counts))
            own = np.array(gains.values, np.int64) if gains.is_valid else np.zeros(0, np.int64)
            sums = np.concatenate([[[0], [0]], np.cumsum([own[numbers] * counts, counts], axis=1, dtype=np.int64)], axis=1)
            ends = np.cumsum(sizes, dtype=np.int64)
            weight, n = sums[:, ends] - sums[:, ends - sizes]
            yield pa.RecordBatch.from_arrays([doc_ids.values, words.values, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, target_key: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; weight sums the gains of the row's features."""
    blocks = feature_blocks(docs, "doc_id", shortest, longest)
    known = dictionary(blocks, feature_blocks(target, target_key, shortest, longest), buckets)
    gains = known.filter("here > 0").join(F.broadcast(bucket_gains(known, buckets)), "bucket").select("feature", "gain")
    back = _exploded(blocks).join(gains, "feature").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("number", "gain"))).alias("x"))
    joined = blocks.drop("features", "totals").join(back.select("block", F.col("x.gain").alias("gains")), "block", "left")
    with batch_rows(docs.sparkSession, 4):
        return stage(joined.mapInArrow(_weigh, _WEIGHTS), "weights")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with ``rank`` from 1 in a total order: sorted by ranges, then one base per range.

    The bases are one row per partition of the sort, which bounds the broadcast.
    """
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place within it in the lower 33
    placed = stage(rows.orderBy(*order).withColumn("at", at), "ranked").withColumn("part", F.shiftrightunsigned("at", 33))
    totals = placed.groupBy("part").agg(F.count("*").alias("n"))
    bases = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + place + 1).drop("at", "part", "base")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, target_key: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank; rank is null for what isn't drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weights(docs, target, shortest, longest, buckets, target_key).withColumn("score", F.col("weight") + noise)
    fit = F.col("n_words") >= least_words
    drawn = rows.filter(fit).count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    high = ranked(rows.filter(fit).select(*names[:4], F.monotonically_increasing_id().alias("rid")), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid")])
    none = F.lit(None).cast("long")
    high = high.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return high.select(*names).unionByName(rows.filter(~fit).withColumn("rank", none).select(*names))


# crc32 is summed byte by byte over a table of its 256 remainders, as DuckDB has no such function
ORACLE = r"""
WITH tbl AS (SELECT list(r ORDER BY b) AS rem FROM (SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS r FROM range(256) t(b))),
     d AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
     e AS (SELECT row_number() OVER () AS rid, doc_id, side,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
     f AS (SELECT rid, side, unnest(words) AS word FROM e),
     u AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM f),
     k AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
                            lambda c, b: xor(c >> 8, rem[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM u, tbl),
     n AS (SELECT bucket, count(*) FILTER (side = 0)::DOUBLE AS s, count(*) FILTER (side = 1)::DOUBLE AS t FROM f JOIN k USING (word) GROUP BY bucket),
     a AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n),
     g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM n, a),
     w AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
     r AS (SELECT e.rid, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                  ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM e LEFT JOIN w ON w.rid = e.rid WHERE side = 0),
     x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
     y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, rid) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank FROM y
"""
