"""Token ids in shard files compressed by Re-Pair grammars, with random access by document.

A block holds the ids of consecutive documents. Frequent neighbouring id pairs are replaced by
nonterminals, many pairs a round, until no pair repeats often enough or the symbols run out. No
pair reaches over a document's end. The block stores the rules, how many ids each rule expands to,
and how many symbols and ids each document has, so that one document is decoded by itself.

Layout, little-endian: magic ``RPG1``; uint32 documents, first nonterminal, rules, symbols; int64
doc_id, uint32 symbols and uint32 ids of each document; uint32 pairs of the rules; uint32
expansion lengths; then the symbols as uint16, or uint32 where they need it.

Defined cases: a null text counts as empty and still has its end id; null ids come first; rows of one
id stand in the order of their texts, and repeated rows are written each; a text of any length is
taken whole, in one worker's memory; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_ids, map_arrow, shared_dir
from sparkloom.llm.units import encoder, gathered

MAGIC = b"RPG1"
#: Null ids are stored as this value.
NULL_ID = -(1 << 63)
SYMBOL_BITS = 16
PAIRS_A_ROUND = 4096
LEAST_COUNT = 8
#: Places of the table that finds a round's pairs by hash.
SLOT_BITS = 20
#: About this many ids make a block.
BLOCK_IDS = 2_000_000


def compress(ids: np.ndarray, sizes: np.ndarray, vocabulary: int, rounds: int | None = None, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols of each document, and rules (one pair each) of a block of ids.

    Rounds go on until no pair stands ``least`` times or the symbols of SYMBOL_BITS run out. A vocabulary
    that leaves less than PAIRS_A_ROUND of them gets symbols of 32 bits. Chosen pairs are found by a table
    of hashes; only pairs that share their slot with another are searched for.
    """
    most = 1 << SYMBOL_BITS
    if vocabulary + PAIRS_A_ROUND > most:
        most = 1 << 32
    kind = np.uint32 if most <= 65_536 else np.uint64
    half = 4 * kind().itemsize
    shift, odd, down = kind(half), kind(0x9E3779B97F4A7C15 >> (64 - 2 * half) | 1), kind(2 * half - SLOT_BITS)
    seq = ids.astype(kind)
    last = np.zeros(len(seq), bool)  # ends of documents, over which no pair reaches
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    ends = int(np.count_nonzero(last))
    rules: list[np.ndarray] = []
    fresh = vocabulary
    while len(seq) > 1 and fresh < most and (rounds is None or len(rules) < rounds):
        keys = seq[:-1] << shift
        keys |= seq[1:]
        keys[last[:-1]] = ~kind(0)  # no pair: its symbol would be the last, after which rounds end
        ordered = np.sort(keys)[: len(keys) - ends + 1]
        # a key that stands n times equals the key least - 1 places on n - least + 1 times
        pairs = ordered[np.flatnonzero(ordered[least - 1 :] == ordered[: max(0, len(ordered) - least + 1)])]
        if not len(pairs):
            break
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        counts = np.diff(first, append=len(pairs))
        chosen = np.sort(pairs[first[np.argsort(-counts, kind="stable")[: min(PAIRS_A_ROUND, most - fresh)]]])
        left, right = chosen >> shift, chosen & ((kind(1) << shift) - kind(1))
        slots = np.full(1 << SLOT_BITS, -1, np.int16)
        slots[(chosen * odd) >> down] = np.arange(len(chosen))
        hashed = keys * odd
        hashed >>= down
        place = slots[hashed]
        at = np.flatnonzero(place >= 0)
        place, found = place[at].astype(np.int64), keys[at]
        # other keys of a slot, and chosen pairs that lost theirs to another
        other = np.flatnonzero(chosen[place] != found)
        place[other] = np.minimum(np.searchsorted(chosen, found[other]), len(chosen) - 1)
        match = np.ones(len(at), bool)
        match[other] = chosen[place[other]] == found[other]
        at, place = at[match], place[match]
        # of touching matches every other one is replaced, from the left
        touch = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        new_run = np.append(True, np.diff(touch) != 1)[: len(touch)]
        begin = np.maximum.accumulate(np.where(new_run, touch, 0))
        alone = np.ones(len(at), bool)
        alone[touch[(touch - begin) % 2 == 0]] = False
        at, place = at[alone], place[alone]
        seq[at] = (fresh + place).astype(kind)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([left, right], 1).astype(np.uint32))
        fresh += len(chosen)
    symbols = np.zeros(len(sizes), np.uint32)
    symbols[sizes > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return seq.astype(np.uint32), symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(len(rules), np.int64)
    plain = (rules < vocabulary).all(1)
    out[plain] = 2
    while (out == 0).any():
        known = np.concatenate([np.ones(1, np.int64), out])
        sides = known[np.where(rules >= vocabulary, rules.astype(np.int64) - vocabulary + 1, 0)]
        ready = (out == 0) & (sides > 0).all(1)
        out[ready] = sides[ready].sum(1)
    return out.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.uint32)
    while len(deep := np.flatnonzero(seq >= vocabulary)):
        width = np.ones(len(seq), np.int64)
        width[deep] = 2
        place = np.cumsum(width) - width
        pair = rules[seq[deep] - vocabulary]
        out = np.empty(int(width.sum()), np.uint32)
        out[place] = seq
        out[place[deep]] = pair[:, 0]
        out[place[deep] + 1] = pair[:, 1]
        seq = out
    return seq


def write_block(doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> bytes:
    symbols, own, rules = compress(ids, sizes, vocabulary)
    kind = "<u2" if vocabulary + len(rules) <= 65_536 and (not len(symbols) or symbols.max() < 65_536) else "<u4"
    head = struct.pack("<4sIIIIB", MAGIC, len(sizes), vocabulary, len(rules), len(symbols), 2 if kind == "<u2" else 4)
    return b"".join((head, doc_ids.astype("<i8").tobytes(), own.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(rules, vocabulary).astype("<u4").tobytes(), symbols.astype(kind).tobytes()))


class Block:
    """A block as read; ``document(k)`` decodes only that document."""

    def __init__(self, data: bytes):
        magic, docs, self.vocabulary, rules, symbols, width = struct.unpack_from("<4sIIIIB", data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        at = struct.calcsize("<4sIIIIB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.symbol_counts, self.sizes = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self.symbol_ends = np.cumsum(self.symbol_counts, dtype=np.int64)

    def document(self, k: int) -> np.ndarray:
        end = int(self.symbol_ends[k])
        return expand(self.symbols[end - int(self.symbol_counts[k]) : end], self.rules, self.vocabulary)

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """ids start..stop of document k; symbols that end before start or begin after stop stay packed."""
        end = int(self.symbol_ends[k])
        own = self.symbols[end - int(self.symbol_counts[k]) : end].astype(np.int64)
        width = np.where(own >= self.vocabulary, self.lengths[np.maximum(own - self.vocabulary, 0)] if len(self.lengths) else 1, 1).astype(np.int64)
        ends = np.cumsum(width)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a] - width[a]) if a < len(own) else 0
        return expand(own[a:b], self.rules, self.vocabulary)[start - skipped : stop - skipped]

    def all(self) -> np.ndarray:
        """All ids: each rule is expanded once, and each symbol is a span of those ids."""
        pool = np.concatenate([np.arange(self.vocabulary, dtype=np.uint32), expand(self.vocabulary + np.arange(len(self.rules)), self.rules, self.vocabulary)])
        sizes = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths])
        starts = np.cumsum(sizes) - sizes
        width = sizes[self.symbols]
        place = np.cumsum(width) - width
        at = np.repeat(starts[self.symbols] - place, width)
        at += np.arange(len(at))
        return pool[at]


BLOCKS = "part int, block int, docs long, tokens long, payload binary"


def write_corpus(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write blocks in ascending doc_id order (nulls first) under ``path``.

    The rows are dealt by ranges of doc_id into as many shards as the scan has splits; a shard's
    blocks are rows of a Parquet file, as only Spark can write to every store.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        vocabulary = coder.tokenizer.get_vocab_size()
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, block
            names = np.array([NULL_ID if x is None else x for own in held for x in own[0]], np.int64)
            sizes = np.concatenate([x[2] for x in held])
            data = write_block(names, np.concatenate([x[1] for x in held]), sizes, vocabulary)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "docs", "tokens", "payload"])
            held.clear()
            n, block = 0, block + 1
            return out

        for names, texts in gathered(batches):
            ids, sizes = coder.encode(texts)
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            held.append((names, ids, sizes + 1))
            n += len(ids)
            if n >= block_ids:
                yield flush()
        if held:
            yield flush()

    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))
    map_arrow(dealt, run, BLOCKS).write.parquet(path)


def read_corpus(spark, path: str) -> DataFrame:
    """Per document of the written files: doc_id, start, n_tokens and the crc32 of its ids.

    Starts come from per-shard totals and running sums within a shard, so no task sees all blocks.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    own = blocks.select("part", "block", "tokens")
    totals = own.groupBy("part").agg(F.sum("tokens").alias("t"))
    # one row per shard, far fewer than documents
    bases = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    inner = own.select("part", "block", (F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")).alias("within"))
    begins = inner.join(bases, "part").select("part", "block", (F.col("base") + F.col("within")).alias("begin"))
    rows = blocks.join(begins, ["part", "block"]).select("begin", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                ids = block.all()
                sizes = block.sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                crc = [crc32_ids(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                names = pa.array([None if x == NULL_ID else x for x in block.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array(begin + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the corpus to the shared folder and read it back."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/sparkloom/tokens-{uuid.uuid4().hex}"
    write_corpus(docs, tokenizer_path, path)
    return read_corpus(docs.sparkSession, path)
