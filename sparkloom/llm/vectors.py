"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample. Every vector is assigned to its
nearest centroid and its residual coded, one byte a subspace. How many lists a query probes, and how
many of a list are ranked exactly, is set from the recall of sampled queries against brute force over
all rows, as the share of lists that holds the neighbours depends on the data and its size. A query probes the nearest lists;
asymmetric distance tables rank a list's codes, and the best of them are ranked again by exact
distance in double precision. Lists are split into chunks of bounded size, so that a list with very
many equal vectors never meets in one task.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, as neighbour or query; ties go to the smaller vec_id; with few
candidates all are returned; repeated ids are separate rows, each with its own ranks as a query, and
never neighbours of their own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import stage

#: Vectors that the index is fitted on, at most.
FIT_ROWS = 16_384
LIST_ROWS = 256
MOST_LISTS = 4096
#: Lists probed, and rows of a list ranked exactly, at least.
PROBES = 32
CHUNK_ROWS = 4096
RERANK = 128
#: Recall that both are raised for, on this many sampled queries.
RECALL, SAMPLE = 0.98, 64
SUBSPACES = 16
NEIGHBOURS = 10


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; an empty cluster takes the point that lies farthest from its centroid."""
    k = max(1, min(k, len(x)))
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, gap = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if not full.all():
            centroids[~full] = x[np.argsort(-gap)[: int((~full).sum())]]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, gap = [], []
    norms = (centroids**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = norms - 2 * part @ centroids.T
        own = d.argmin(1)
        near.append(own)
        gap.append(d[np.arange(len(part)), own] + (part**2).sum(1))
    return (np.concatenate(near), np.concatenate(gap)) if near else (np.zeros(0, np.int64), np.zeros(0))


@dataclass
class IvfPq:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = SUBSPACES) -> IvfPq:
        centroids = kmeans(x, lists)
        residual = x - centroids[nearest(x, centroids)[0]]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
        return cls(centroids, [kmeans(residual[:, a:b], 256, 6) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def spans(self):
        return zip(self.cuts, self.cuts[1:], self.books, strict=False)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)[0]
        residual = x - self.centroids[own]
        return own, np.stack([nearest(residual[:, a:b], book)[0] for a, b, book in self.spans()], 1).astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(d, 1, kind="stable")[:, :n]

    def distances(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to coded vectors of list ``at``, from one table a subspace."""
        r = query - self.centroids[at]
        tables = [((book - r[a:b]) ** 2).sum(1) for a, b, book in self.spans()]
        return sum(t[codes[:, k]] for k, t in enumerate(tables))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as vec_id and embedding."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("embedding") == sizes[0]["n"]) if sizes else rows


def exact_neighbours(coded: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """query (place in ids), vec_id and list of the k nearest rows to each of a few queries, by brute force."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))]
        for batch in batches:
            if batch.num_rows:
                own, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                rows = np.array(batch.column(2).to_pylist(), np.float64)
                d = np.stack([np.sqrt(((rows - q) ** 2).sum(1)) for q in x])
                d[ids[:, None] == own] = np.inf
                kept = [np.concatenate([a, np.broadcast_to(b, d.shape)], 1) for a, b in zip(kept, (own, at, d), strict=True)]
                order = np.lexsort((kept[0], kept[2]), axis=-1)[:, :k]
                kept = [np.take_along_axis(a, order, 1) for a in kept]
        good = np.isfinite(kept[2])
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(good)[0], pa.int32()), *(pa.array(a[good]) for a in kept)], ["query", "vec_id", "list", "d"])

    found = coded.select("vec_id", "list", "embedding").mapInArrow(near, "query int, vec_id long, list long, d double")
    order = Window.partitionBy("query").orderBy("d", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).toPandas()


def search(vectors: DataFrame, query_every: int = 100, k: int = NEIGHBOURS, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """The k nearest found for each row whose vec_id is divisible by query_every: query_id, rank, vec_id, score.

    probes and rerank are the least that is taken.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(FIT_ROWS).toPandas()
    index = IvfPq.fit(np.array(picked["embedding"].tolist(), np.float64), min(MOST_LISTS, max(1, n // LIST_ROWS), max(1, len(picked) // 4)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                own, codes = index.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["vec_id", "list", "code", "embedding"])

    coded = stage(rows.mapInArrow(assign, "vec_id long, list int, code binary, embedding array<double>"), "coded")
    sizes = {x["list"]: x["count"] for x in coded.groupBy("list").count().collect()}  # a row for each list at most
    chunks = [max(1, -(-sizes.get(i, 0) // CHUNK_ROWS)) for i in range(len(index.centroids))]
    per = F.array(*map(F.lit, chunks)) if len(chunks) <= 1 else F.lit(chunks)
    dealt = coded.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.element_at(per, F.col("list") + 1)).cast("int"))

    def answers(queries: DataFrame, probes: int, rerank: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(1).to_pylist(), np.float64)
                    out = [(r, int(i), c) for r, own in enumerate(index.probes(x, probes)) for i in own for c in range(chunks[i])]
                    at = pa.array([r for r, _, _ in out], pa.int32())
                    columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array([i for _, i, _ in out], pa.int32()), pa.array([c for _, _, c in out], pa.int32()), batch.column(1).take(at)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_row", "list", "chunk", "query"])

        # repeated ids are told apart by a row number; queries are read once, from staged rows
        numbered = queries.select("vec_id", "embedding", F.monotonically_increasing_id().alias("query_row"))
        asked = numbered.mapInArrow(ask, "query_id long, query_row long, list int, chunk int, query array<double>")

        def best(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(asked):
                return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_row": "int64", "vec_id": "int64", "score": "float64"})
            own = own.sort_values("vec_id", kind="stable")
            ids = own["vec_id"].to_numpy()
            x = np.array(own["embedding"].tolist(), np.float64)
            codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            out = []
            for query_id, query_row, query in zip(asked["query_id"], asked["query_row"], asked["query"], strict=True):
                q = np.array(query, np.float64)
                rough = index.distances(q, int(key[0]), codes)
                rough[ids == query_id] = np.inf
                at = np.sort(np.argsort(rough, kind="stable")[:rerank])
                at = at[ids[at] != query_id]
                exact = np.sqrt(((x[at] - q) ** 2).sum(1))
                top = np.argsort(exact, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": query_id, "query_row": query_row, "vec_id": ids[at[top]], "score": exact[top]}))
            return pd.concat(out)

        found = dealt.groupBy("list", "chunk").cogroup(asked.groupBy("list", "chunk")).applyInPandas(best, "query_id long, query_row long, vec_id long, score double")
        order = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # the rows in picked are in hash order, so the first of them are a sample
    some = picked.drop_duplicates("vec_id").head(SAMPLE)
    x = np.array(some["embedding"].tolist(), np.float64)
    true = exact_neighbours(coded, some["vec_id"].to_numpy(), x, k)
    if len(true):
        place = np.argsort(index.probes(x, len(index.centroids)), 1)[true["query"], true["list"]]
        # the least number of lists that holds RECALL of the neighbours, with room for what the codes lose
        probes = max(probes, int(np.sort(place)[math.ceil((1 + RECALL) / 2 * len(place)) - 1]) + 1)
        sampled = spark.createDataFrame(some[["vec_id", "embedding"]].assign(embedding=list(map(list, some["embedding"]))), "vec_id long, embedding array<double>")
        want = set(zip(some["vec_id"].to_numpy()[true["query"]].tolist(), true["vec_id"].tolist(), strict=True))
        while rerank < CHUNK_ROWS:
            got = {(r.query_id, r.vec_id) for r in answers(sampled, probes, rerank).collect()}
            if len(got & want) >= RECALL * len(want):
                break
            rerank *= 2
    return answers(coded.filter(F.col("vec_id") % query_every == 0), probes, rerank)
