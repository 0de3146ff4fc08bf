"""Best-fit packing of documents into fixed-length token sequences, in bounded space.

The packer keeps at most ``open_bins`` bins. A bitset has bit f set while some open bin has f free
tokens, so the best fit for n tokens is the lowest set bit from n up. When a bin more is needed
than may be open, the fullest bin closes. Pieces come in the order of their ids; the packer looks
WINDOW pieces ahead and places the longest of them first, so that what it holds is bounded by the
window and the open bins, whatever comes. Bins of different groups never mix, so groups pack in
parallel. Ids are made by a tokenizers file; only documents longer than a sequence are cut.

Defined cases: a null text counts as empty and still has its end id; a null doc_id packs like any
other; repeated rows are packed each; pieces of equal length are placed in their order; a text of any
length is cut whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_ids, map_arrow, stage
from sparkloom.llm.units import MEMO_UNITS, encoder, gathered

SEQUENCE_TOKENS = 2048
OPEN_BINS = 512
#: Pieces that the packer looks ahead.
WINDOW = 1024
#: Pieces in a packing group; a group packs in one task.
GROUP_PIECES = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: full ones, after a shorter first one where n isn't a multiple."""
    rest, full = n % most, n // most
    return [rest] * bool(rest) + [most] * full


def pieces(docs: DataFrame, tokenizer_path: str, most: int = SEQUENCE_TOKENS, end_id: int = 0, memo_units: int = MEMO_UNITS) -> DataFrame:
    """One row per piece of each document: its place in the document, length and crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, memo_units)
        for names, texts in gathered(batches, min(4_000_000, 10 * memo_units)):
            ids, sizes = coder.encode(texts)
            out: list[tuple] = []
            at = 0
            for name, size in zip(names, sizes.tolist(), strict=True):
                own = np.append(ids[at : at + size], np.uint32(end_id))
                at += size
                start = 0
                for k, length in enumerate(cut_lengths(len(own), most)):
                    out.append((name, k, start, length, crc32_ids(own[start : start + length])))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


class BestFit:
    """Online best-fit with a fixed number of open bins."""

    def __init__(self, most: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.most, self.open_bins = most, open_bins
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(most + 1)]
        self.opened = 0
        self.bins = 0

    def _take(self, bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def _pop(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.free_bits &= ~(1 << free)
        self.opened -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The bin for an item and its offset there."""
        fits = self.free_bits >> length
        if fits:
            free = self._take(fits) + length
            place = self._pop(free)
        else:
            if self.opened >= self.open_bins:
                self._pop(self._take(self.free_bits))  # the fullest closes
            free, place = self.most, self.bins
            self.bins += 1
        if left := free - length:
            self.by_free[left].append(place)
            self.free_bits |= 1 << left
            self.opened += 1
        return place, self.most - free


def windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows again, ``size`` at a time where that many of one _group follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column("_group").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                if held and held[0].column("_group")[0].as_py() != group[a]:
                    yield pa.concat_batches(held)
                    held = []
                take = min(b - a, size - sum(x.num_rows for x in held))
                held.append(batch.slice(a, take))
                a += take
                if sum(x.num_rows for x in held) == size:
                    yield pa.concat_batches(held)
                    held = []
    if held:
        yield pa.concat_batches(held)


def pack(rows: DataFrame, most: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length.

    Rows are dealt evenly into groups by a hash, so no group grows with the input.
    """
    spark = rows.sparkSession
    groups = max(1, -(-rows.count() // group_pieces))
    schema = rows.schema
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)).cast("int"))
    parts = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(parts, "_group").sortWithinPartitions("_group", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, BestFit(most, open_bins)
        for batch in windows(batches, window):
            here = batch.column("_group")[0].as_py()
            if here != group:
                group, packer = here, BestFit(most, open_bins)
            length = batch.column("length").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.argsort(-length, kind="stable").tolist():
                place, offset[k] = packer.put(int(length[k]))
                sequence[k] = (here << 32) | place
            kept = [batch.column(x.name) for x in schema]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*schema.names, "sequence_id", "offset"])

    out = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, most: int = SEQUENCE_TOKENS, memo_units: int = MEMO_UNITS) -> DataFrame:
    """Tokenize and pack; the pieces are staged, as they are counted before they are dealt."""
    return pack(stage(pieces(docs, tokenizer_path, most, memo_units=memo_units), "pieces"), most)
