"""Language-model scores by context-tree weighting over byte contexts.

A text's words, lower-cased, are written with one space between and an end byte. Each byte is eight
binary decisions; each decision has a tree of contexts, the bytes before it, up to DEPTH of them. A
node's Krichevsky-Trofimov estimate is mixed half and half with the product of its children, so
the probability of a byte mixes the estimates of all depths. The trees are fixed by the counts of
training texts; a text's score is the sum of the predictive probabilities of its bytes.

The corpus is cut into blocks of some megabytes, staged once. Each block sends its distinct
(context, byte) strings with training counts to shards by the last two context bytes; a shard holds
whole subtrees, and levels 0 and 1 are joined from at most 256 x 255 rows. The shard's answers go
back to the blocks, which sum them by text. Word counts of the base score take the same way.

Defined cases: a null text counts as empty (its end alone is scored); null ids train or not by the
crc32 of the empty string; repeated rows train and score once each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SpanHash, by_shard, crc_of_id, discard, free_shuffles, map_arrow, mix64, pack_array, pack_keys, stage, texts_of, unpack_array, unpack_keys

DEPTH = 5
BLOCK_BYTES = 4_000_000
#: Bytes of blocks that a shard of byte strings stands for, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 12_000_000, 32
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HALF = np.log(0.5)


def canonical(text: str) -> tuple[bytes, int]:
    """The bytes that are scored, and the number of tokens with the end."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    return b" ".join(words) + b"\n", len(words) + 1


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 6; good to about 1e-12 for positive x."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    z = x + 6
    inverse = 1 / z
    square = inverse * inverse
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) - shift


BLOCK = "block_id long, ids array<long>, held array<boolean>, tokens array<int>, sizes array<int>, payload binary"


def blocks(docs: DataFrame, rule) -> DataFrame:
    """Blocks of scored bytes; ``rule`` is a boolean column over doc_id that marks held-out rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, tokens, parts = [], [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            row = [[number], [list(ids)], [list(held)], [list(tokens)], [[len(p) for p in parts]], [data]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            for x in (ids, held, tokens, parts):
                x.clear()
            number, total = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block_id", "ids", "held", "tokens", "sizes", "payload"])

        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                data, n = canonical(text)
                if parts and total + len(data) > BLOCK_BYTES:
                    yield flush()
                ids.append(doc_id)
                held.append(out)
                tokens.append(n)
                parts.append(data)
                total += len(data)
        if parts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rule.alias("held"), "text")
    return map_arrow(rows, run, BLOCK)


class BlockKeys:
    """Keys of each byte and of each token of a block."""

    def __init__(self, payload: bytes, sizes: np.ndarray, depth: int):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        place = np.arange(n) - np.repeat(self.starts, sizes)
        self.bytes = np.zeros(n, np.uint64)
        for back in range(1, depth + 1):
            before = np.zeros(n, np.uint64)
            before[back:] = data[:-back] if n > back else 0
            before[place < back] = 0  # contexts begin anew with each text
            self.bytes |= before << np.uint64(8 * (depth + 1 - back))
        self.bytes |= data
        space = (data == 32) | (data == 10)
        begin = ~space
        begin[1:] &= space[:-1]
        last = ~space
        last[:-1] &= space[1:]
        begins = np.flatnonzero(begin)
        marks = ends - 1  # the end of each text is a token too
        spans = SpanHash(data)
        keys = np.concatenate([spans.spans(begins, np.flatnonzero(last) + 1), np.ones(len(sizes), np.uint64)])
        order = np.argsort(np.concatenate([begins, marks]), kind="stable")
        self.tokens = keys[order]
        self.token_doc = (np.searchsorted(ends, np.concatenate([begins, marks])[order], "right")).astype(np.int64)


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys rising, and how often each stands in training rows."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(train[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def shard_of(keys: np.ndarray, kind: int, depth: int, shards: int) -> np.ndarray:
    """Byte strings go by their last two context bytes, words by their hash."""
    base = keys if kind else keys >> np.uint64(8 * (depth - 1))
    return (mix64(base + np.uint64(1)) % np.uint64(shards)).astype(np.int64) + kind * shards


REQUEST = "shard int, block_id long, keys binary, counts binary"


def requests(staged: DataFrame, depth: int, shards: int) -> DataFrame:
    """Distinct keys of each block by shard, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                own = BlockKeys(row["payload"], sizes, depth)
                train = ~np.array(row["held"], bool)
                out = []
                for kind, keys, of in ((0, own.bytes, np.repeat(train, sizes)), (1, own.tokens, train[own.token_doc])):
                    keys, counts = distinct(keys, of)
                    shard = shard_of(keys, kind, depth, shards)
                    order = np.argsort(shard, kind="stable")
                    cuts = np.searchsorted(shard[order], np.arange(kind * shards, (kind + 1) * shards + 1))
                    for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), kind * shards):
                        if b > a:
                            out.append((s, row["block_id"], pack_keys(keys[order[a:b]]), pack_array(counts[order[a:b]].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block_id", "keys", "counts"])

    return map_arrow(staged.select("block_id", "held", "sizes", "payload"), run, REQUEST)


class Subtrees:
    """Nodes of depth 2 and more whose contexts end with the shard's byte pairs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.depth = keys, depth
        self.log_w: dict[tuple[int, int], np.ndarray] = {}
        self.stop: dict[tuple[int, int], np.ndarray] = {}
        self.kt: dict[tuple[int, int], np.ndarray] = {}
        self.node: dict[tuple[int, int], np.ndarray] = {}
        # entries of depth d: distinct (context of d bytes, byte), found by sorting shortened keys
        byte = keys & np.uint64(255)
        entry_keys, entry_counts = keys, counts
        entry_of = np.arange(len(keys))
        for d in range(depth, 1, -1):
            if d < depth:
                short = ((keys >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | byte
                entry_keys, first, entry_of = np.unique(short, return_index=True, return_inverse=True)
                entry_counts = np.bincount(entry_of, counts, len(entry_keys))
            symbols = (entry_keys & np.uint64(255)).astype(np.int64)
            for k in range(8):
                group = entry_keys >> np.uint64(8 - k)
                new = np.concatenate([[True], group[1:] != group[:-1]])
                at = np.flatnonzero(new)
                node = np.cumsum(new) - 1
                bit = (symbols >> (7 - k)) & 1
                ones = np.add.reduceat(entry_counts * bit, at).astype(float)
                zeros = np.add.reduceat(entry_counts * (1 - bit), at).astype(float)
                log_e = log_kt(zeros, ones)
                mine = node[entry_of]
                if d == depth:
                    log_w, stop = log_e, np.ones(len(log_e))
                else:
                    child = self.node[d + 1, k]
                    lead = np.zeros(len(self.log_w[d + 1, k]), np.int64)
                    lead[child] = mine  # each child's parent
                    below = np.bincount(lead, self.log_w[d + 1, k], len(log_e))
                    log_w = np.logaddexp(_HALF + log_e, _HALF + below)
                    stop = np.exp(_HALF + log_e - log_w)
                self.log_w[d, k], self.stop[d, k], self.node[d, k] = log_w, stop, mine
                self.kt[d, k] = (ones + 0.5) / (ones + zeros + 1)
                if d == 2:
                    entry = np.flatnonzero(new)
                    self.top = getattr(self, "top", [])
                    head = (group[entry] >> np.uint64(k)).astype(np.int64)
                    self.top.append((k, head >> 8, (1 << k) | (symbols[entry] >> (8 - k)), zeros, ones, log_w))

    def roots(self) -> list[tuple[int, int, float, float, float]]:
        """For each (last byte, node): zeros, ones and the summed log weights of the depth-2 nodes here."""
        out = []
        for _, last, node, zeros, ones, log_w in self.top:
            key = last * 256 + node
            names, own = np.unique(key, return_inverse=True)
            out += list(zip((names >> 8).tolist(), (names & 255).tolist(), np.bincount(own, zeros).tolist(), np.bincount(own, ones).tolist(), np.bincount(own, log_w).tolist(), strict=True))
        return out

    def predict(self, roots: Roots) -> np.ndarray:
        """log10 probability of each key's byte after its context."""
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        last = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
        total = np.zeros(len(byte))
        for k in range(8):
            p = self.kt[self.depth, k][self.node[self.depth, k]]
            for d in range(self.depth - 1, 1, -1):
                own = self.node[d, k]
                w = self.stop[d, k][own]
                p = w * self.kt[d, k][own] + (1 - w) * p
            at = (1 << k) | (byte >> (8 - k))
            w = roots.stop1[last, at]
            p = w * roots.kt1[last, at] + (1 - w) * p
            w = roots.stop0[at]
            p = w * roots.kt0[at] + (1 - w) * p
            bit = (byte >> (7 - k)) & 1
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


class Roots:
    """Levels 0 and 1 of all trees: at most 256 x 255 nodes."""

    def __init__(self, rows: list):
        zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
        for last, node, a, b, w in rows:
            zeros[last, node], ones[last, node], below[last, node] = a, b, w
        log_e = log_kt(zeros, ones)
        log_w = np.logaddexp(_HALF + log_e, _HALF + below)
        self.stop1, self.kt1 = np.exp(_HALF + log_e - log_w), (ones + 0.5) / (zeros + ones + 1)
        a, b = zeros.sum(0), ones.sum(0)
        log_e = log_kt(a, b)
        log_w0 = np.logaddexp(_HALF + log_e, _HALF + log_w.sum(0))
        self.stop0, self.kt0 = np.exp(_HALF + log_e - log_w0), (b + 0.5) / (a + b + 1)


def shard_counts(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Merged keys and counts; merged now and then, so that memory follows distinct keys."""
    parts, size = [], 0
    for _, keys, counts in held:
        parts.append((unpack_keys(keys), unpack_array(counts, "<u4").astype(np.int64)))
        size += len(parts[-1][0])
        if size > 4_000_000 and len(parts) > 1:
            parts = [merge(parts)]
            size = len(parts[0][0])
    return merge(parts)


def log_scores(docs: DataFrame, held_rule=None, depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rule = (crc_of_id() % 5 == 1) if held_rule is None else held_rule
    staged = stage(blocks(docs, rule), "lm-blocks")
    size = staged.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    shards = max(LEAST_SHARDS, int(size) // SHARD_BYTES)
    asked = stage(requests(staged, depth, shards), "lm-requests")

    def root_rows(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = shard_counts(held)
        if shard >= shards:
            out = [(1, 0, 0, float(counts.sum()), float((counts > 0).sum()), 0.0)]
        else:
            out = [(0, *x) for x in Subtrees(keys, counts, depth).roots()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["kind", "last", "node", "zeros", "ones", "log_w"])

    tops = by_shard(asked, shards, root_rows, "kind int, last int, node int, zeros double, ones double, log_w double")
    tops = tops.groupBy("kind", "last", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log_w")).collect()  # 256 x 255 rows and one at most
    free_shuffles(docs.sparkSession)
    roots = Roots([tuple(x)[1:] for x in tops if x["kind"] == 0])
    train_tokens, known = next(((int(x[3]), int(x[4])) for x in tops if x["kind"] == 1), (0, 0))

    def answers(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = shard_counts(held)
        values = counts.astype("<f8") if shard >= shards else Subtrees(keys, counts, depth).predict(roots).astype("<f4")
        for block_id, own, _ in held:
            yield pa.RecordBatch.from_arrays([pa.array([block_id]), pa.array([shard], pa.int32()), pa.array([pack_array(values[np.searchsorted(keys, unpack_keys(own))])], pa.binary())], ["block_id", "shard", "found"])

    # answers are staged as they come, so that requests go before answers are dealt to blocks, which is done once
    told = stage(by_shard(asked, shards, answers, "block_id long, shard int, found binary"), "lm-answers")
    discard(asked, shuffles=True)
    joined = staged.join(told.groupBy("block_id").agg(F.collect_list(F.struct("shard", "found")).alias("told")), "block_id")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.log10(train_tokens + 0.5 * (known + 1))
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                own = BlockKeys(row["payload"], sizes, depth)
                found = {x["shard"]: x["found"] for x in row["told"]}
                values = []
                for kind, keys in ((0, own.bytes), (1, own.tokens)):
                    names, back = np.unique(keys, return_inverse=True)
                    shard = shard_of(names, kind, depth, shards)
                    order = np.argsort(shard, kind="stable")
                    here = np.empty(len(names))
                    here[order] = np.concatenate([unpack_array(found[s], "<f8" if kind else "<f4") for s in np.unique(shard).tolist()])
                    values.append(here[back])
                score = np.add.reduceat(values[0], own.starts)
                n = len(sizes)
                base = np.bincount(own.token_doc, np.log10(values[1] + 0.5) - floor, n)
                seen = np.bincount(own.token_doc, values[1] > 0, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["tokens"], pa.int64()), pa.array(seen), pa.array(np.full(n, train_tokens)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return map_arrow(joined.select("ids", "held", "tokens", "sizes", "payload", "told"), total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
