"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities, nearness of lexicon words to the second person, capitals,
punctuation and obfuscation rates. The lexicon is a short fixed list joined with words and word
beginnings that mark toxic texts among part of the training rows; the trees learn from another
part and the calibration from a third. Training takes FIT_ROWS labelled rows at most, chosen by a
hash of the id, never from the held-out fold.

Defined cases: a null or empty text is scored like any other; null ids are held out or not by the
crc32 of the empty string; repeated rows keep their rows; with no labels of both kinds every score
is the share of toxic labels (0 without labels); further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_of_id, map_arrow, stage, texts_of
from sparkloom.llm.trees import BoostedTrees, isotonic
from sparkloom.llm.units import forget

#: Labelled training rows used, at most.
FIT_ROWS = 12_000
#: Learned lexicon entries, at most.
LEXICON_SIZE = 1_500
#: Common English insults.
SEED_LEXICON = ("asshole", "bastard", "bitch", "clown", "crap", "creep", "disgusting", "dumb", "fool", "freak", "fuck", "garbage", "hate", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless")
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine euch tu toi te ton ta vous votre tú ti usted".split())
_WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
_OBFUSCATED = re.compile(r"[^\W\d_][@$*!0-9]+[^\W\d_]")
_LEET = str.maketrans("@$!01345", "asioieas")
_NEAR = 5
N_FEATURES = 18


def stems(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 letters, marked as such."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


class Lexicon(dict):
    """Weight of each word, found once per distinct word."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        plain = word if word.isalpha() else word.translate(_LEET)
        found = max([0.0, *(self.weights.get(s, 0.0) for s in stems(plain))])
        self[word] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(len(words), 1)
    weights = [lexicon[w] for w in words]
    hits = [k for k, w in enumerate(weights) if w > 0]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(int(raw.sum()), 1)
    upper, small = int(raw[65:91].sum()), int(raw[97:123].sum())
    digits = int(raw[48:58].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    near = second = 0
    window = 0.0
    if hits:
        you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        second = len(you)
        if you:
            at = np.array(you)
            for k in hits:
                j = np.searchsorted(at, k)
                near += bool((j < len(at) and at[j] - k <= _NEAR) or (j and k - at[j - 1] <= _NEAR))
        place = np.array(hits)
        window = float((np.searchsorted(place, place + 50) - np.arange(len(place))).max())
    own = [weights[k] for k in hits]
    return [
        math.log1p(len(text)), len(hits) / n, math.log1p(len(hits)), sum(own) / n, sum(own), max(own, default=0.0),
        len({words[k] for k in hits}), near / n, near, second / n, upper / max(upper + small, 1), digits / size, marks / size,
        int(raw[33]) / size, int(raw[63]) / size, len(_OBFUSCATED.findall(text)) / n, window, size / n,
    ]


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic and part (0..99) of at most ``rows`` labelled rows outside the held-out fold.

    Of a repeated id the highest label and the least text count, so that runs agree.
    """
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter(crc_of_id() % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the bound makes the broadcast safe
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    return own.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(100)).cast("int"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Weights of words and beginnings that are far likelier in toxic texts; the fixed list is in any case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[bool(toxic)].update({s for w in set(_WORD.findall(text.lower())) for s in stems(w)} | {""})
        names = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][x] for x in names], pa.int64()), pa.array([found[0][x] for x in names], pa.int64())], ["term", "pos", "neg"])

    sums = rows.select("text", "toxic").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = stage(sums.filter("pos >= 3 or term = ''"), "lexicon")
    whole = sums.filter("term = ''").collect()
    weights = {w: 3.0 for w in SEED_LEXICON}
    if whole and whole[0]["pos"] and whole[0]["neg"]:
        ratio = F.log((F.col("pos") + 0.5) / (whole[0]["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (whole[0]["neg"] + 1))
        best = sums.filter("term <> ''").withColumn("w", ratio).filter("w > 3").orderBy(F.desc(F.col("w") * F.sqrt("pos")), "term").limit(size)
        weights |= {x["term"]: float(x["w"]) for x in best.collect()}
    return weights


class Model:
    """A lexicon, trees over its features, and the calibration of their output."""

    def __init__(self, weights: dict[str, float], trees: BoostedTrees | None, knots: tuple[np.ndarray, np.ndarray], share: float):
        self.weights, self.trees, self.knots, self.share = weights, trees, knots, share

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.decision(x)
        p = 1 / (1 + np.exp(-raw))
        if not len(self.knots[0]):
            return p
        # a little of the trees' own output keeps the order within a flat stretch
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * p, 0.0, 1.0)


def with_features(rows: DataFrame, weights: dict[str, float], keep: list[str]) -> DataFrame:
    fields = {x.name: x.dataType.simpleString() for x in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            x = [features(t, lexicon) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return map_arrow(rows, run, ", ".join(f"{k} {fields[k]}" for k in keep) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    own = stage(training_rows(docs, labels, rows), "toxic-fit")
    weights = learn_lexicon(own.filter("part < 40"))
    table = with_features(own.filter("part >= 40"), weights, ["toxic", "part", "doc_id"]).orderBy("doc_id").toPandas()  # FIT_ROWS at most
    y = (table["toxic"].to_numpy() == 1).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(weights, None, (np.zeros(0), np.zeros(0)), float(y.mean()) if len(y) else 0.0)
    x = np.array(table["x"].tolist(), float)
    late = table["part"].to_numpy() >= 80
    if y[~late].min() == y[~late].max():
        late[:] = False
    trees = BoostedTrees().fit(x[~late], y[~late])
    if late.sum() < 20 or y[late].min() == y[late].max():
        return Model(weights, trees, (np.zeros(0), np.zeros(0)), float(y.mean()))
    return Model(weights, trees, isotonic(trees.decision(x[late]), y[late]), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            p = model.scores(np.array([features(t, lexicon) for t in texts_of(batch.column("text"))], float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id() % 5 == 0).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't mark, with their own columns."""
    model = fit(docs, labels)
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        lexicon = Lexicon(model.weights)
        for batch in batches:
            if batch.num_rows:
                p = model.scores(np.array([features(t, lexicon) for t in texts_of(batch.column("text"))], float))
                yield batch.filter(pa.array(p < 0.5))

    return map_arrow(docs, run, fields)
