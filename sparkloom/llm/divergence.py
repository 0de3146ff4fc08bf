"""Audit of how the sources of a language differ in their words, by sorted runs.

A task numbers the terms of a block of texts, sorts its tokens by (language, source, term,
document) and counts runs, so that one row per block, source and term is shuffled, however common
the term. The rows are dealt by (lang, term) and sorted by source; a scan adds up runs as they pass
and holds one term's sources at a time. Terms in enough documents are kept.

Every group gives every kept term a smoothed share p, in billionths, so that all sums are exact.
The divergence of two sources is the sum of f = floor((p-q)^2 / (p+q)) over the kept terms. Most
terms are missing from most sources, so the sum is taken apart: a term that one of the two has
depends on its count alone and comes from a histogram of counts; what terms that both have add to
that comes from a second scan, which sums pairs of sources over its runs before it emits them.

Defined cases: null text, lang and source count as empty strings; each row is a document, also
where ids are null or repeat; texts without terms still make their group; an empty table gives no
rows; equal values are ranked by the UTF-8 order of the item; further columns are ignored. A text
of any length is one document of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, join_groups, small_batches, stage
from sparkloom.llm.words import LETTERS, batch_rows, numbering, strings, text_bytes

BLOCK_BYTES = 32_000_000
SCAN_ROWS = 50_000
#: Pairs of sources that are compared at a time, and sums that a task holds before it emits them.
PAIR_ROWS = 2_000_000
HELD_PAIRS = 1_000_000
SLOTS = 16
BILLION = 1_000_000_000

_COUNTED = "lang string, term string, source string, docs long, n long"
_KEPT = "lang string, term string, source string, n long, total long, first boolean"


class _Block:
    """Tokens of a block's documents, as numbers."""

    def __init__(self):
        self.terms = numbering()
        self.groups: dict[tuple[str, str], int] = {}
        self.ids: list[np.ndarray] = []
        self.group_of: list[int] = []
        self.size = 0

    def add(self, raw: bytes, lang: str, source: str) -> None:
        found = LETTERS.findall(raw.lower())
        if found:
            self.ids.append(np.fromiter(map(self.terms.__getitem__, found), np.int64, len(found)))
            self.group_of.append(self.groups.setdefault((lang, source), len(self.groups)))
            self.size += len(raw)

    def counted(self) -> pa.RecordBatch:
        """One row per group and term: in how many documents, and how often."""
        sizes = [len(x) for x in self.ids]
        key = np.concatenate(self.ids)
        key += np.repeat(np.array(self.group_of, np.int64), sizes) * len(self.terms)
        order = np.argsort(key, kind="stable")  # tokens stand by document already, and stay so within a key
        key, document = key[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= document[1:] != document[:-1]
        docs = np.add.reduceat(fresh.astype(np.int64), at)
        group, term = np.divmod(key[at], len(self.terms))
        langs, sources = (pa.array(x, pa.string()).take(pa.array(group)) for x in zip(*self.groups, strict=True))
        return pa.RecordBatch.from_arrays([langs, strings(list(self.terms)).take(pa.array(term)), sources, pa.array(docs), pa.array(np.diff(at, append=len(key)))], ["lang", "term", "source", "docs", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block.add(*row)
            if block.size >= BLOCK_BYTES:
                yield from _sliced(block.counted())
                block = _Block()
    if block.ids:
        yield from _sliced(block.counted())


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, SCAN_ROWS):
        yield batch.slice(k, SCAN_ROWS)


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _runs(batches: Iterator[pa.RecordBatch], scan: Callable[[pa.Table, np.ndarray], tuple[pa.Table | None, pa.Table]]) -> Iterator[pa.Table]:
    """Call scan(rows, where terms begin) on sorted rows of whole terms, the last term of a call is held back till the next.

    ``scan`` returns what it found and what it makes of the rows that are held back.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        found, held = scan(rows, np.flatnonzero(_changes(rows, ["lang", "term"])))
        if found is not None:
            yield found
    if held is not None:
        end = pa.concat_tables([held, held.slice(0, 1).set_column(1, "term", pa.array([None], pa.string()))])
        found, _ = scan(end, np.array([0, held.num_rows]))
        if found is not None:
            yield found


def _keep(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(rows: pa.Table, begins: np.ndarray) -> tuple[pa.Table | None, pa.Table]:
        news = _changes(rows, ["source"])
        news[begins] = True
        at = np.flatnonzero(news)
        docs, n = (np.add.reduceat(rows.column(c).to_numpy(), at) for c in ("docs", "n"))
        merged = rows.select(["lang", "term", "source"]).take(pa.array(at)).append_column("docs", pa.array(docs)).append_column("n", pa.array(n))
        terms = np.searchsorted(at, begins)
        last = int(terms[-1])
        if last == 0:
            return None, merged
        sizes = np.diff(terms)
        total = np.repeat(np.add.reduceat(n[:last], terms[:-1]), sizes)
        first = np.zeros(last, bool)
        first[terms[:-1]] = True
        enough = pa.array(np.repeat(np.add.reduceat(docs[:last], terms[:-1]) >= least, sizes))
        out = merged.slice(0, last).drop_columns(["docs"]).append_column("total", pa.array(total)).append_column("first", pa.array(first))
        return out.filter(enough), merged.slice(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _runs(batches, scan):
            yield from found.combine_chunks().to_batches()

    return run


def counted_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, source, n, total, first: counts of each term that at least ``least`` documents of its language hold.

    ``total`` is the count in the language; ``first`` marks one row of each term. Staged.
    """
    spark = docs.sparkSession
    rows = docs.select(text_bytes().alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    small_batches(spark)
    counted = stage(rows.mapInArrow(_count, _COUNTED), "term-counts")
    with batch_rows(spark, SCAN_ROWS):
        kept = stage(counted.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_keep(least), _KEPT), "kept-terms")
    discard(counted)
    return kept


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact."""
    top = F.lit(BILLION).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the third array by the first two."""
    a, b, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, v = a[order], b[order], v[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.add.reduceat(v, at)


def _pairs_of(groups: np.ndarray, p: np.ndarray, zero: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two sources of one run: what the run adds beyond the two sums over single counts."""
    n = len(p)
    left = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n))) - np.arange(n) - 1  # partners after a row
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(np.cumsum(left[first:]), PAIR_ROWS)) + first)
        many = left[first:last]
        a = np.repeat(np.arange(first, last), many)
        if len(a):
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            value = _distance(p[a], p[b]) - _distance(p[a], zero[b]) - _distance(zero[a], p[b]) + _distance(zero[a], zero[b])
            yield _summed([(groups[a], groups[b], value)])
        first = last


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, value) for pairs of sources with common terms, summed over a task's runs."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def scan(rows: pa.Table, begins: np.ndarray) -> tuple[pa.Table | None, pa.Table]:
        last = int(begins[-1])
        if last:
            held.extend(_pairs_of(*(rows.column(c).to_numpy()[:last] for c in ("gid", "p", "zero")), begins[:-1]))
        if sum(len(x[0]) for x in held) > HELD_PAIRS:
            held[:] = [_summed(held)]
            if len(held[0][0]) > HELD_PAIRS:
                return pa.table(list(held.pop()), ["a", "b", "v"]), rows.slice(last)
        return None, rows.slice(last)

    for found in _runs(batches, scan):
        yield from found.to_batches()
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held))), ["a", "b", "v"])


def _by_language(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Join on lang, which is nearly all rows' one key: rows in slots, the few others in every slot."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))
    return rows.withColumn("slot", F.pmod("gid", F.lit(SLOTS)).cast("int")).join(others.withColumn("slot", slots), ["lang", "slot"])


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that stand out."""
    spark = docs.sparkSession
    kept = counted_terms(docs, least)
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own_terms"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("terms"))
    made = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "own_terms", "lang_size", "terms"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("size"), F.col("terms")))
    groups = stage(made.withColumn("gid", F.monotonically_increasing_id()).withColumn("zero", zero), "term-groups")

    joined = join_groups(kept, groups, ["lang", "source"], "own_terms", kept.count())
    shares = joined.select("lang", "term", "source", "gid", "n", "zero", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"))
    shares = stage(shares, "term-shares")
    discard(kept)

    order = W.partitionBy("gid").orderBy(F.desc("value"), "item")
    high = shares.filter("p > q").select("lang", "source", "gid", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = high.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # each unordered pair's common terms once, then both ways
    runs = shares.select("lang", "term", "gid", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "gid")
    with batch_rows(spark, SCAN_ROWS):
        common = stage(runs.mapInArrow(_both, "a long, b long, v long"), "term-pairs")
    counts = shares.groupBy("lang", "gid", "p").agg(F.count("*").alias("many"))
    alone = _by_language(counts, groups.select("lang", F.col("gid").alias("other"), F.col("zero").alias("other_zero"))).filter("gid <> other")
    alone = alone.groupBy(F.col("gid").alias("a"), F.col("other").alias("b")).agg(F.sum(F.col("many") * distance(F.col("p"), F.col("other_zero"))).alias("v"))
    others = groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("own_terms").alias("other_terms"))
    neither = (F.col("terms") - F.col("own_terms") - F.col("other_terms")) * distance(F.col("zero"), F.col("other_zero"))
    every = _by_language(groups, others).filter("gid <> b").select("lang", "source", "item", F.col("gid").alias("a"), "b", F.coalesce(neither, F.lit(0)).alias("v"))
    nameless = [F.lit(None).cast("string").alias(c) for c in ("lang", "source", "item")]
    parts = every
    for half in (common, alone):
        parts = parts.unionByName(half.select(*nameless, "a", "b", "v")).unionByName(half.select(*nameless, F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    pairs = parts.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("lang", "source", "item")), F.sum("v").alias("value")).withColumnRenamed("a", "gid")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    out = [(pairs, "pair"), (terms, "term")]
    shown = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for df, part in out]
    return shown[0].unionByName(shown[1])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
     c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
     gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
     ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                  CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0)::HUGEINT + 2 * v.v) AS HUGEINT) AS p
           FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
           LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
           LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
     q AS (SELECT t.lang, t.term, CAST(1 + (1000000000::HUGEINT * (t.n + 2)) // (ln.n::HUGEINT + 2 * v.v) AS HUGEINT) AS q
           FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t JOIN ln ON ln.lang = t.lang JOIN v ON v.lang = t.lang),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
     terms AS (SELECT p.lang, p.source, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value
               FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
     u AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term' AS part, * FROM terms),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
