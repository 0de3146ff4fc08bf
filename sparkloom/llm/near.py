"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

A text is the multiset of its five-word shingles, each weighted by its count times an inverse
document frequency; a text with fewer words is one shingle. ICWS samples, HASHES of them in BANDS
bands, agree with probability equal to the weighted Jaccard similarity. Texts that share a band are
candidates, candidates are verified by their weighted Jaccard similarity, and verified pairs are
joined to classes by star contraction.

The inverse document frequency of a shingle in n of N rows is 1 + log(N / n) / log(N): 2 for one row,
1 for all. The logarithm is measured against log(N), so that shingles of a large group of copies keep
at least half the weight of an edited word's, at any N. Frequencies are exact: each block of texts
sends its distinct shingles, counted, to shards by hash, and the shards' totals come back.

No group makes all its pairs. Each round compares a band's members with some of them, its pivots,
and joins what is verified; bands that lie in one class are settled, and pivots leave, having met all.
Texts whose bands still span classes after SPLIT rounds meet by the shingles of their prefixes instead:
in one order of all shingles, the rarest first, two texts within the similarity share one of those that
make up the first 1 - SIMILARITY of a text's weight. Pivots grow in number every round up to PIVOTS,
rounds go on until every band has ended, and no pair of a band goes unverified unless its texts are of
one class, without a common prefix shingle, or bound to be unlike by their weights: two texts have at
most the weight in common that either shares with any other row.

Defined cases: a null text counts as empty; texts without words have no candidates; equal texts are
of one class, empty ones too; repeated rows and null ids keep their rows; the class id is the least
doc_id of the class, null only if all are; a text of any length is taken whole, in one worker's memory;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SpanHash, by_shard, discard, free_shuffles, fresh, join_groups, map_arrow, mix64, narrow, pack_array, pack_keys, stage, texts_of, unpack_array, unpack_keys
from sparkloom.llm.graph import components
from sparkloom.llm.units import forget

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
HASHES = BANDS * ROWS
#: Bytes of text in a block, and about how many bytes of text a shard of shingles stands for.
BLOCK_BYTES, SHARD_BYTES = 2_000_000, 24_000_000
#: The round in which bands that still span classes are split by prefix shingles.
SPLIT = 1
#: Pivots of a band in one round: a power of GROWTH, at most PIVOTS; what they don't settle goes to further rounds.
GROWTH, PIVOTS = 32, 256
#: Keys of a text, the least ones, that tell whether a pair met in another band.
MET_KEYS = 8
#: Parts of a text's shingles, by hash, whose weights bound what two texts have in common.
PARTS = 32
#: Pivots that a task holds, and texts that it compares with them.
BLOCK_PIVOTS, DEAL = 64, 4096
#: Steps of a weight of one: weights are whole numbers of them, so that sums are exact.
STEPS = 64
_LOW = np.int64(-(1 << 63))
_FREQUENCY_BITS = np.uint64(0xFFFFFFFFFFFFFF00)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def shingles(data: bytes, sizes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the number of shingles of each text.

    ``data`` holds the words of all texts, each with a space after it; ``sizes`` counts each text's words.
    """
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    raw = np.frombuffer(data, np.uint8)
    spans = SpanHash(raw)
    ends = np.flatnonzero(raw == 32)
    begins = np.append(0, ends[:-1] + 1)
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    first = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    last = first + np.repeat(np.minimum(sizes, words), counts) - 1
    return spans.spans(begins[first], ends[last]), counts


def multisets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (rising), how often each stands there, and how many each text has."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16) if len(counts) < 65_536 else owner[order], kind="stable")]
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return h[at], times, np.bincount(o[at], minlength=len(counts))


def _gamma_quantiles(n: int = 65_536) -> np.ndarray:
    """Quantiles of Gamma(2, 1), where F(x) = 1 - (1 + x) exp(-x), by bisection."""
    u = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo


_GAMMA = _gamma_quantiles()
_R, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def samples(h: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ICWS samples of each text with shingles, one column per hash; texts without get a row of zeros."""
    out = np.zeros((len(sizes), HASHES), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    log_s = np.log(weights).astype(np.float32)
    own = np.repeat(np.arange(len(full)), sizes[full])
    low = np.uint64(0xFFFF)
    for k in range(HASHES):
        x = (h ^ _SEEDS[k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        r = _R[(x >> np.uint64(48)).astype(np.uint16)]
        log_c = _LOG_C[((x >> np.uint64(32)) & low).astype(np.uint16)]
        beta = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65_536)
        t = np.floor(log_s / r + beta)
        a = log_c - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[own])
        who = own[at]
        first = at[np.append(True, who[1:] != who[:-1])]
        out[full, k] = mix64(h[first] ^ mix64(t[first].astype(np.int64).view(np.uint64) + _SEEDS[k]))
    return out


def idf_steps(frequency: np.ndarray, n_rows: int) -> np.ndarray:
    """The inverse document frequency in whole steps."""
    scale = np.log(max(n_rows, 2))
    return np.round(STEPS * (1 + np.log(n_rows / np.minimum(frequency, n_rows)) / scale)).astype(np.int64)


BLOCK = "block_id long, ids array<long>, tids array<binary>, words array<int>, payload binary"


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in blocks: doc_id, the text's own id (16 bytes of its sha256), and its lower-cased words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        number = TaskContext.get().partitionId() << 32
        ids, tids, sizes, parts = [], [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=1).compress(b" ".join([w for own in parts for w in own]) + b" ")
            row = [[number], [list(ids)], [list(tids)], [list(sizes)], [data]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            for x in (ids, tids, sizes, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block_id", "ids", "tids", "words", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if ids and total + len(text) > block_bytes:
                    yield flush()
                    number, total = number + 1, 0
                own = words_of(text)
                ids.append(doc_id)
                tids.append(hashlib.sha256(text.encode("utf-8", "replace")).digest()[:16])
                sizes.append(len(own))
                if own:
                    parts.append(own)
                total += len(text)
        if ids:
            yield flush()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, BLOCK)


def block_multisets(payload: bytes, words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return multisets(*shingles(zstandard.ZstdDecompressor().decompress(payload), np.array(words, np.int64)))


def totals_in_place(keys: np.ndarray, counts: np.ndarray, part: int = 250_000) -> np.ndarray:
    """Of each key the sum of the counts of all keys equal to it, written over ``keys``.

    Keys are sorted in parts by ranges of some ``part`` keys, so that beside keys and counts only their order
    by parts is held whole.
    """
    if not len(keys):
        return keys
    parts = min(65_536, len(keys) // part + 1)
    low, high = keys.min(), keys.max()
    width = (high - low) // np.uint64(parts) + np.uint64(1)
    of = ((keys - low) // width).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(of, minlength=parts))).tolist()
    for a, b in itertools.pairwise(cuts):
        at = order[a:b]
        at = at[np.argsort(keys[at], kind="stable")]
        own = keys[at]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        if len(first):
            keys[at] = np.repeat(np.add.reduceat(counts[at].astype(np.uint64), first), np.diff(np.append(first, len(own))))
    return keys


def frequencies(blocks: DataFrame, shards: int) -> DataFrame:
    """block_id and, by shard, the numbers of rows of all blocks that have each of its distinct shingles.

    A shard is a range of hashes, so a block's shingles in rising order are those of its shards in order.
    Frequencies tell shingles apart by 56 bits of their hash.
    """
    edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, words, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, counts = np.unique(block_multisets(payload, words)[0] & _FREQUENCY_BITS, return_counts=True)
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                out = [(s, block_id, pack_keys(keys[a:b]), pack_array(counts[a:b].astype("<u4"))) for s, (a, b) in enumerate(itertools.pairwise(cuts.tolist())) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block_id", "keys", "counts"])

    def answer(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        forget()
        counts = [unpack_array(counts, "<u4") for _, _, counts in held]
        ends = np.cumsum([len(own) for own in counts]).tolist()
        keys = np.empty(ends[-1], np.uint64)
        for k, (_, own, _) in enumerate(held):
            keys[ends[k] - len(counts[k]) : ends[k]] = unpack_keys(own)
        totals = totals_in_place(keys, np.concatenate(counts))
        for (block_id, _, _), own, end in zip(held, counts, ends, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block_id]), pa.array([shard], pa.int32()), pa.array([pack_array(totals[end - len(own) : end].astype("<i8"))], pa.binary())], ["block_id", "shard", "found"])

    asked = map_arrow(blocks.select("block_id", "words", "payload"), ask, "shard int, block_id long, keys binary, counts binary")
    told = by_shard(asked, shards, answer, "block_id long, shard int, found binary")
    return told.groupBy("block_id").agg(F.collect_list(F.struct("shard", "found")).alias("told"))


def _short(x: np.ndarray, coder: zstandard.ZstdCompressor) -> bytes:
    """An array as one value where all are equal, else compressed."""
    if len(x) and (x == x[0]).all():
        return x[:1].tobytes()
    return coder.compress(x.tobytes()) if len(x) else b""


SIGNED = "doc_id long, tid binary, bands array<long>, total long, shared long, h binary, q binary, t binary"


def signatures(told: DataFrame, n_rows: int) -> DataFrame:
    """Of each row: doc_id, tid, band keys, total weight, weight of shingles that other rows have, and its payload.

    Texts have no band keys that can have no partner: those without words, and those of which less than
    SIMILARITY of the weight is shared, as the similarity is at most that share. The payload is the shingles (32 bits each, rising), their inverse document frequencies and counts.
    ``told`` holds the blocks with their frequencies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for ids, tids, words, payload, found in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                h, times, sizes = block_multisets(payload, words)
                names, back = np.unique(h & _FREQUENCY_BITS, return_inverse=True)
                own = [unpack_array(x["found"], "<i8") for x in sorted(found or (), key=lambda x: x["shard"])]
                q = idf_steps(np.concatenate(own), n_rows)[back] if own else np.zeros(0, np.int64)
                assert sum(map(len, own)) == len(names)
                w = q * times
                ends = np.cumsum(sizes)
                starts = ends - sizes
                total = np.add.reduceat(np.append(w, 0), starts) * (sizes > 0)
                shared = np.add.reduceat(np.append(w * (q < 2 * STEPS), 0), starts) * (sizes > 0)
                paired = (shared >= SIMILARITY * total) & (sizes > 0)
                short, q2, t4 = (h >> np.uint64(32)).astype("<u4"), q.astype("<u2"), times.astype("<u4")
                first = 0
                while first < len(ids):  # some 50,000 shingles at a time stay in the processor's caches
                    last = max(first + 1, int(np.searchsorted(ends, starts[first] + 50_000, "right")))
                    a, b = int(starts[first]), int(ends[last - 1])
                    found30 = samples(h[a:b], w[a:b], sizes[first:last]).reshape(last - first, BANDS, ROWS)
                    keys = np.zeros((last - first, BANDS), np.uint64)
                    for r in range(ROWS):
                        keys = mix64(keys + found30[:, :, r] + np.uint64(r + 1))
                    cuts = list(zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[first:last], pa.int64()),
                            pa.array(tids[first:last], pa.binary()),
                            pa.array([k.tolist() if some else [] for k, some in zip(keys.view(np.int64), paired[first:last].tolist(), strict=True)], pa.list_(pa.int64())),
                            pa.array(total[first:last], pa.int64()),
                            pa.array(shared[first:last], pa.int64()),
                            pa.array([short[x:y].tobytes() for x, y in cuts], pa.binary()),
                            pa.array([_short(q2[x:y], coder) for x, y in cuts], pa.binary()),
                            pa.array([_short(t4[x:y], coder) for x, y in cuts], pa.binary()),
                        ],
                        ["doc_id", "tid", "bands", "total", "shared", "h", "q", "t"],
                    )
                    first = last

    return map_arrow(told.select("ids", "tids", "words", "payload", "told"), run, SIGNED)


def _long(data: bytes, kind: str, n: int) -> np.ndarray:
    one = np.dtype(kind).itemsize
    return np.broadcast_to(np.frombuffer(data, kind), n) if len(data) == one else unpack_array(data, kind)


def shingle_weights(h: bytes, q: bytes, t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their inverse document frequencies, and their weights."""
    names = np.frombuffer(h, "<u4")
    if not len(names):
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    idf = _long(q, "<u2", len(names)).astype(np.int64)
    return names, idf, idf * _long(t, "<u4", len(names))


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of shingles a, b (rising) with weights x, y."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    both = int(np.minimum(x[hit], y[at[hit]]).sum())
    return both / (int(x.sum()) + int(y.sum()) - both)


def verify(pairs: DataFrame, homes: DataFrame, loads: DataFrame) -> DataFrame:
    """sim of each pair (pivot a, b), from pairs and the pivots' homes (a, home).

    The pivots of a home, a band that they were drawn from, stand together in blocks of BLOCK_PIVOTS, so that
    a text that is compared with many of them is sent once a block. A block with many texts is dealt over
    tasks, each of which gets its pivots once.
    """
    n_pairs, n_pivots = max(1, pairs.count()), homes.count()
    counts = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_PIVOTS).cast("int").alias("blocks"))
    placed = homes.join(counts, "home").select("a", "home", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    placed = stage(narrow(narrow(placed, n_pivots).join(narrow(pairs.groupBy("a").agg(F.count("*").alias("n")), n_pivots), "a"), n_pivots), "pivot-blocks")
    own = narrow(join_groups(pairs, placed, ["a"], "n", n_pairs), n_pairs)
    asked = stage(narrow(own.groupBy("home", "block", "b").agg(F.collect_list("a").alias("pivots")), n_pairs), "pivot-texts")
    n_asked = max(1, asked.count())
    sizes = stage(narrow(asked.groupBy("home", "block").agg(F.count("*").alias("n")).withColumn("deals", F.ceil(F.col("n") / DEAL).cast("int")), n_pivots), "block-sizes")
    dealt = join_groups(asked, sizes, ["home", "block"], "n", n_asked)
    # texts come with their shingles, so that fewer of them make a task
    right = narrow(narrow(dealt, n_asked).withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).join(loads.withColumnRenamed("uid", "b"), "b"), n_asked, DEAL // 2)
    left = narrow(placed.drop("n").join(sizes, ["home", "block"]), n_pivots).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    left = narrow(left.join(loads.withColumnRenamed("uid", "a"), "a"), n_pivots, DEAL // 2)
    columns = ["home", "block", "deal", "b", "pivots", "h", "q", "t"]
    first = left.withColumn("b", F.lit(None).cast("long")).withColumn("pivots", F.array("a")).select(*columns)
    rows = narrow(first.unionByName(right.select(*columns)).repartition("home", "block", "deal"), n_asked + n_pivots, DEAL // 2)
    rows = rows.sortWithinPartitions("home", "block", "deal", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            out = []
            for home, block, deal, b, pivots, h, q, t in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (home, block, deal) != now:
                    now, held = (home, block, deal), {}
                names, _, weights = shingle_weights(h, q, t)
                if b is None:
                    held[pivots[0]] = (names, weights)
                else:
                    out += [(a, b, similarity(names, weights, *held[a])) for a in pivots]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "sim"])

    out = stage(map_arrow(rows, run, "a long, b long, sim double"), "band-sims")
    discard(placed, asked, sizes)
    return out


def prefix(names: np.ndarray, idf: np.ndarray, weights: np.ndarray, least: float) -> np.ndarray:
    """Places of the shingles, the rarest first, that hold over 1 - least of a text's weight."""
    order = np.lexsort((names, -idf))
    n = int(np.searchsorted(np.cumsum(weights[order]), (1 - least) * weights.sum() * (1 + 1e-9), "right")) + 1
    return order[:n]


def split(active: DataFrame, loads: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Bands (key, uid, total, shared, root, keys, parts) of one prefix shingle each; texts of a band that are linked share one.

    ``parts`` holds the weight of a text's shared shingles in each of PARTS parts by hash: two texts have at most
    the lesser weight of each part in common, which tells apart texts that were edited in different places.
    """
    single = 2 * STEPS  # the inverse document frequency of one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, total, shared, root, h, q, t in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                names, idf, weights = shingle_weights(h, q, t)
                at = prefix(names, idf, weights, least)
                at = at[idf[at] < single]  # no other text has those of one row
                if not len(at):
                    continue
                own = names[at].astype(np.uint64) | (idf[at].astype(np.uint64) << np.uint64(32))
                parts = np.unique(mix64(own).view(np.int64))
                n = len(parts)
                common = idf < single
                held = np.bincount(names[common] % PARTS, weights[common], PARTS).astype(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(parts), *(pa.array(np.full(n, x)) for x in (uid, total, shared, root)), pa.array([parts[:MET_KEYS].tolist()] * n, pa.list_(pa.int64())), pa.array([held] * n, pa.list_(pa.int64()))], ["key", "uid", "total", "shared", "root", "keys", "parts"])

    texts = active.select("uid", "total", "shared", "root").distinct()
    return map_arrow(texts.join(loads, "uid").select("uid", "total", "shared", "root", "h", "q", "t"), run, "key long, uid long, total long, shared long, root long, keys array<long>, parts array<long>")


def spanning(active: DataFrame) -> DataFrame:
    """Staged members of the bands that hold more than one class, with the band's size n; ``active`` is staged."""
    n = max(1, active.count())
    sizes = active.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "n")
    sizes = stage(narrow(sizes, n), "band-sizes")
    out = stage(narrow(join_groups(active, sizes, ["key"], "n", n), n), "band-members")
    discard(sizes)
    return out


def links(bands: DataFrame, loads: DataFrame, least: float = SIMILARITY, split_at: int = SPLIT) -> DataFrame:
    """node and root of all texts that are linked within a band, from bands (key, uid, total, shared, keys).

    ``keys`` holds the least keys of a text: a pair is made in the first band that it shares, as far as they tell.
    """
    active = spanning(bands.withColumns({"root": F.col("uid"), "parts": F.lit(None).cast("array<long>")}))  # bands are staged
    tested = roots = None
    for turn in itertools.count():
        n_active = active.count()
        if not n_active:
            break
        if turn == split_at:
            parts = stage(split(active, loads, least), "band-parts")
            discard(active)
            active = spanning(parts)
            discard(parts)
            n_active = max(1, active.count())
        # one pivot at first, the least of a band, as it is that of many bands; then more, single texts first
        if turn == 0:
            pivots = active.groupBy("key").agg(F.first("n").alias("n"), F.min(F.struct("uid", "total", "shared", "root", "keys", "parts")).alias("p"))
            pivots = pivots.select("key", "n", F.array("p").alias("pivots"))
        else:
            slot = F.pmod(F.xxhash64("uid", "key", F.lit(turn)), F.lit(min(GROWTH**turn, PIVOTS)))
            single = F.lit(False) if turn < split_at else F.col("root") != F.col("uid")
            pivots = active.groupBy("key", slot.alias("slot")).agg(F.first("n").alias("n"), F.min(F.struct(single.alias("joined"), "uid", "total", "shared", "root", "keys", "parts")).alias("p"))
            pivots = pivots.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("p.uid", "p.total", "p.shared", "p.root", "p.keys", "p.parts")).alias("pivots"))
        pivots = stage(narrow(pivots, n_active), "band-pivots")
        met = narrow(join_groups(active.drop("n"), pivots, ["key"], "n", n_active), n_active, 20_000)
        # two texts have at most what each shares with others in common, and neither can be much heavier
        most = "least(shared, p.shared, total, p.total)"
        # a pair is left to a lesser band that both are in: it is made there once one of them is a pivot, unless they are of one class by then
        first = " and not exists(keys, x -> x < key and array_contains(p.keys, x))"
        near = f"p -> p.root <> root and p.uid <> uid and {most} >= {least - 1e-9} * (total + p.total - {most}){first}"
        if turn >= split_at:  # nor have they more in common than in each part of their shingles
            both = "aggregate(zip_with(parts, p.parts, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"
            near += f" and {both} * {1 + least - 1e-9}D >= {least - 1e-9}D * (total + p.total)"
        met = met.select("uid", F.explode(F.expr(f"transform(filter(pivots, {near}), p -> p.uid)")).alias("pivot"))
        pairs = narrow(met.select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct(), n_active)
        if tested is not None:
            done = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = narrow(pairs.join(done, ["a", "b"], "left_anti"), n_active)
        pairs = stage(pairs, "band-pairs")
        if not pairs.isEmpty():
            homes = narrow(pivots.select("key", F.explode("pivots.uid").alias("a")).groupBy("a").agg(F.min("key").alias("home")), n_active)
            sims = verify(pairs, homes, loads)
            edges = sims.filter(F.col("sim") >= least).select(F.col("a").alias("u"), F.col("b").alias("v"))
            if roots is not None:
                edges = edges.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = stage(components(edges), "band-roots")
            tested = sims if tested is None else tested.unionByName(sims)
        discard(pairs)
        # pivots leave, as they have met their whole band
        left = active.drop("root", "n").join(pivots.select("key", F.explode("pivots.uid").alias("uid")), ["key", "uid"], "left_anti")
        if roots is not None:
            left = narrow(left, n_active).join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        left = stage(narrow(left.withColumn("root", F.coalesce("root", "uid") if roots is not None else F.col("uid")), n_active), "band-left")
        after = spanning(left)
        discard(active, pivots, left, shuffles=True)
        active = after
    return roots if roots is not None else bands.select(F.col("uid").alias("node"), F.col("uid").alias("root")).limit(0)


def classes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, tid, class_id, class_size (rows), n_texts (distinct texts of the class)."""
    blocks = stage(text_blocks(docs), "near-blocks")
    n_rows, n_words = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    n_rows = int(n_rows or 0)
    shards = max(8, 6 * int(n_words or 0) // SHARD_BYTES)
    told = stage(frequencies(blocks, shards), "near-frequencies")
    free_shuffles(docs.sparkSession)
    signed = stage(signatures(blocks.join(told, "block_id", "left"), n_rows), "near-signed")
    discard(blocks, told, shuffles=True)
    rows = stage(signed.select("doc_id", "tid"), "near-rows")
    texts = signed.groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("total").alias("total"), F.first("shared").alias("shared"))
    texts = stage(texts.withColumn("uid", F.monotonically_increasing_id()), "near-texts")
    n_texts = max(1, texts.count())
    least_keys = F.slice(F.array_sort(F.transform("bands", lambda v, i: F.xxhash64(i, v))), 1, MET_KEYS)
    keys = texts.select("uid", "total", "shared", least_keys.alias("keys"), F.posexplode("bands").alias("band", "value"))
    keys = keys.select(F.xxhash64("band", "value").alias("key"), "uid", "total", "shared", "keys")
    sizes = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-sizes")
    bands = stage(join_groups(keys, sizes, ["key"], "n", n_texts).select("key", "uid", "total", "shared", "keys"), "near-bands")
    # one row of each candidate text goes on: that of the least id, and one of those that repeat it
    low = F.lit(int(_LOW))
    wanted = bands.select("uid").distinct().join(texts.select("uid", "tid", F.coalesce("first_id", low).alias("at")), "uid")
    loads = signed.withColumn("at", F.coalesce("doc_id", low)).select("tid", "at", "h", "q", "t").join(wanted, ["tid", "at"])
    loads = stage(loads.select("uid", "h", "q", "t").dropDuplicates(["uid"]), "near-loads")
    discard(signed, sizes, shuffles=True)
    roots = links(bands, loads)
    rooted = texts.select("tid", "uid", "n", "first_id").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rooted = stage(rooted.drop("uid"), "near-rooted")
    discard(loads, bands, texts, shuffles=True)
    whole = stage(rooted.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts")), "near-classes")
    by_text = join_groups(rooted.select("tid", "n", "root"), whole, ["root"], "n_texts", n_texts)
    by_text = stage(by_text.select("tid", "n", "class_id", "class_size", "n_texts"), "text-classes")
    return join_groups(rows, by_text, ["tid"], "n", max(1, n_rows)).drop("n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, n_texts, kept (the class's least id)."""
    return classes(docs).select("doc_id", "class_id", "class_size", "n_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each class, with its own columns; repeated rows count once."""
    tid, at = fresh("tid", docs.columns), fresh("at", docs.columns)
    low = F.lit(int(_LOW))
    kept = classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("tid").alias(tid), F.coalesce("doc_id", low).alias(at)).distinct()
    marked = docs.withColumns({tid: F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), 1, 16), at: F.coalesce(F.col("doc_id").cast("long"), low)})
    return marked.join(kept, [tid, at], "left_semi").dropDuplicates([tid, at]).select(*docs.columns)
