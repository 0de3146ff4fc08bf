"""Removal of long byte strings that occur more than once, by suffix order.

Every window of WIDTH bytes belongs to the least of its SEED-byte hashes; runs of windows with one
least hash are segments, so equal windows lie in segments of equal key. Equal segments are counted
together before anything is gathered, so groups of copies collapse to one row. A key that occurs once,
with its seed once, has no repeats. Segments of the other keys are dealt into shards of about SHARD_BYTES by key, each
shard's suffixes are sorted by induction with common prefixes carried along (induced.py), and a
window repeats where a neighbour shares WIDTH bytes. The verdicts return to all equal segments.

Defined cases: a null text counts as empty; texts shorter than WIDTH stay whole; repeated rows and
null ids keep their rows, and repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SpanHash, discard, free_shuffles, join_groups, map_arrow, stage, texts_of
from sparkloom.llm.induced import repeated_windows

WIDTH = 400
#: Bytes of a passage of 50 words, counted as four letters and a space each: the width for corpora.
PASSAGE_BYTES = 250
SEED = 64
#: The arrays of a shard take some 80 times its size, in each of the workers of an executor.
SHARD_BYTES = 1_500_000
#: Ranges of window places that candidates() tells apart.
STEPS = 12


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours, from block minima taken both ways."""
    n = len(h)
    x = np.concatenate([h, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments_of(data: bytes, width: int, seed: int):
    """key, digest, start, number of windows, and whether the seed stands there twice, of each segment.

    The text has at least width bytes. Only a segment with its seed twice can repeat within itself.
    """
    spans = SpanHash(np.frombuffer(data, np.uint8))
    w = width - seed + 1
    h = spans.grams(seed)
    least = window_least(h, w)
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    windows = np.diff(np.append(start, len(least)))
    keys = least[start]
    # places of seeds that are the least of some window that holds them
    pad = np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)
    seeds = np.flatnonzero(h == ~window_least(np.concatenate([pad, ~least, pad]), w))
    names, own = np.unique(keys, return_inverse=True)
    scale = len(h) + w + 1
    code = np.sort(np.searchsorted(names, h[seeds]) * scale + seeds)
    twice = np.searchsorted(code, own * scale + start + windows + w - 1) - np.searchsorted(code, own * scale + start) > 1
    return keys.view(np.int64), spans.spans(start, start + windows + width - 1).view(np.int64), start, windows, twice


def candidates(keys: np.ndarray, bodies: list[bytes], width: int, seed: int, steps: int = STEPS) -> list[tuple[int, int, int]]:
    """(segment, first window, end) of the windows that can stand in another segment of the key.

    A window's place is fixed by where it holds the seed. The places are cut into ``steps`` ranges; all
    windows of a range hold one core of nearly ``width`` bytes, so windows whose core no other segment
    has are out. Nothing is left out of keys with a segment where the seed stands more than once.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    windows = sizes - width + 1
    spans = SpanHash(np.frombuffer(b"".join(bodies), np.uint8))
    grams = spans.grams(seed).view(np.int64)
    owner = np.repeat(np.arange(len(bodies)), sizes)[: len(grams)]
    at = np.flatnonzero(grams == keys[owner])
    at = at[at + seed <= ends[owner[at]]]
    times = np.bincount(owner[at], minlength=len(bodies))
    whole = np.isin(keys, np.unique(keys[times != 1]))
    out = [(k, 0, int(windows[k])) for k in np.flatnonzero(whole)]
    one = at[~whole[owner[at]]]
    who = owner[one]
    edges = np.linspace(0, width - seed + 1, steps + 1).astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low, high in zip(edges, edges[1:] - 1, strict=False):
        first = np.maximum(one - high - begins[who], 0)
        end = np.minimum(one - low - begins[who] + 1, windows[who])
        has = first < end
        code = spans.spans(one[has] - low, one[has] - high + width) ^ keys[who[has]].view(np.uint64)
        _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
        shared = counts[back] > 1
        found.append((who[has][shared], first[has][shared], end[has][shared]))
    own, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, own))
    for k, x, y in zip(own[order].tolist(), first[order].tolist(), end[order].tolist(), strict=True):
        if out and out[-1][0] == k and out[-1][2] >= x and not whole[k]:
            out[-1] = (k, out[-1][1], max(y, out[-1][2]))
        else:
            out.append((k, x, y))
    return out


def window_runs(starts: np.ndarray) -> list[int]:
    """Rising window starts as [first, end, first, end, ...]."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + 1], 1).ravel().tolist()


def staged_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_rid, the kept columns, and the text's bytes compressed."""
    fields = {x.name: x.dataType.simpleString() for x in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [coder.compress(x.encode("utf-8", "replace")) for x in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), *(batch.column(k) for k in keep), pa.array(data, pa.binary())], ["_rid", *keep, "_z"])

    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), *keep, "text")
    return stage(map_arrow(rows, run, "_rid long, " + "".join(f"`{k}` {fields[k]}, " for k in keep) + "_z binary"), "repeat-texts")


def repeated_spans(texts: DataFrame, width: int = WIDTH, seed: int = SEED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """_rid and the window starts that repeat: a list of (segment start, [first, end, ...])."""
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for rid, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = coder.decompress(z)
                if len(data) >= width:
                    own = segments_of(data, width, seed)
                    out.append((np.full(len(own[0]), rid), *own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out, strict=True), (np.int64, np.int64, np.int64, np.int32, np.int32, np.bool_), strict=True)], ["_rid", "key", "digest", "start", "windows", "twice"])

    rows = stage(map_arrow(texts.select("_rid", "_z"), cut, "_rid long, key long, digest long, start int, windows int, twice boolean"), "segments")
    groups = rows.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("_rid", "start", "windows")).alias("rep"), F.max("twice").alias("twice"))
    keys = groups.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.max("twice").alias("twice")).filter("total > 1 or twice")
    chosen = stage(groups.drop("twice").join(keys, "key").select("key", "digest", "n", F.expr("m > 1 or twice").alias("sorts"), "rep"), "segment-groups")
    several = chosen.filter("sorts")
    size = several.agg(F.sum(F.col("rep.windows") + (width - 1))).collect()[0][0] or 0
    shards = max(1, -(-int(size) // shard_bytes))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = coder.decompress(z)
                out += [(x["key"], x["digest"], x["n"], data[x["start"] : x["start"] + x["windows"] + width - 1]) for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "digest", "n", "body"])

    wanted = several.select(F.col("rep._rid").alias("_rid"), F.struct("key", "digest", "n", F.col("rep.start").alias("start"), F.col("rep.windows").alias("windows")).alias("x")).groupBy("_rid").agg(F.collect_list("x").alias("wanted"))
    strings = map_arrow(texts.select("_rid", "_z").join(wanted, "_rid").select("_z", "wanted"), bodies, "key long, digest long, n long, body binary")
    dealt = strings.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "digest")

    def sort_shard(held: list) -> Iterator[pa.RecordBatch]:
        bodies_ = [x[3] for x in held]
        parts = candidates(np.array([x[0] for x in held], np.int64), bodies_, width, seed)
        if not parts:
            return
        found = repeated_windows([bodies_[k][x : y + width - 1] for k, x, y in parts], width)
        runs: dict[int, list[int]] = {}
        for (k, x, _), starts in zip(parts, found, strict=True):
            if len(starts) and held[k][2] == 1:
                runs.setdefault(k, []).extend(window_runs(starts + x))
        if runs:
            own = [(*held[k][:2], r) for k, r in runs.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["key", "digest", "runs"])

    def sort_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if row[0] != now and held:
                    yield from sort_shard(held)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield from sort_shard(held)

    free_shuffles(spark)
    sorted_ = map_arrow(dealt.select("shard", "key", "digest", "n", "body"), sort_all, "key long, digest long, runs array<int>")
    whole = chosen.filter("n > 1").select("key", "digest", F.array(F.lit(0), F.col("rep.windows")).alias("runs"), "n")
    verdicts = stage(whole.unionByName(sorted_.withColumn("n", F.lit(1).cast("long"))), "segment-verdicts")
    discard(chosen, shuffles=True)
    told = join_groups(rows.select("_rid", "key", "digest", "start"), verdicts, ["key", "digest"], "n", max(1, rows.count()))
    told = stage(told.groupBy("_rid").agg(F.collect_list(F.struct("start", "runs")).alias("runs")), "repeat-runs")
    discard(rows, verdicts, shuffles=True)
    return told


def covered(size: int, runs: list | None, width: int) -> np.ndarray:
    """Which of a text's bytes lie in a repeated window."""
    edge = np.zeros(size + 1, np.int32)
    for x in runs or ():
        for a, b in zip(x["runs"][::2], x["runs"][1::2], strict=True):
            edge[x["start"] + a] += 1
            edge[x["start"] + b - 1 + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def removal(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = staged_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    joined = texts.join(repeated_spans(texts, width), "_rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, z, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = coder.decompress(z)
                gone = covered(len(data), runs, width)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
                out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined.select("doc_id", "_z", "runs"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated passages cut out of text (and n_chars, if there, of what is left).

    A cut inside a character drops what remains of the character. Columns of any names are kept.
    """
    columns, names = docs.schema, docs.columns
    # own names, so that none clashes with those of the operator
    held = [f"kept{k}" for k in range(len(names))]
    docs = docs.toDF(*("text" if c == "text" else h for c, h in zip(names, held, strict=True)))
    keep = [h for c, h in zip(names, held, strict=True) if c != "text"]
    texts = staged_texts(docs, keep)
    joined = texts.join(repeated_spans(texts, width), "_rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, runs in zip(batch.column("_z").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = coder.decompress(z)
                out.append(np.frombuffer(data, np.uint8)[~covered(len(data), runs, width)].tobytes().decode("utf-8", "ignore") if runs else data.decode())
            made = {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                made["n_chars"] = pa.array([len(x) for x in out], batch.column(held[names.index("n_chars")]).type)
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(h) for c, h in zip(names, held, strict=True)], names)

    return map_arrow(joined.select(*keep, "_z", "runs"), run, columns)
