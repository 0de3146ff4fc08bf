"""The best documents of each query by the weights of the terms they share, without scoring all that share one.

An inverted index holds the documents of every term that some query has. The first documents of each
term, those with the highest boost, are scored in full; the k-th best of them bounds the result from
below. Terms are then put in the order of their frequency. Once the weights of the terms that are
left cannot lift a document to the bound, their postings are not read for candidates: a document of
the result has one of the terms before. Candidates are scored in full by a join on (term, document).
A term that all documents have is therefore only read for documents that another term brings up.

Cases: queries and documents have distinct ids; a query without terms, or whose terms no document
has, gives no rows; equal scores go to preferred documents, then to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents of a term that are scored to find the bound.
CHAMPIONS = 64


def weight(term: Column | str, long: int) -> Column:
    """Two for a term of ``long`` letters or more, else one."""
    return F.when(F.length(term) >= long, 2).otherwise(1)


class TermIndex:
    """Documents (doc_id, terms, source, topic, boost, prefer) by term; only for terms that the queries have."""

    def __init__(self, docs: DataFrame, queries: DataFrame, long: int, topic_boost: int = 0):
        self.docs, self.topic_boost = docs, topic_boost
        self.asked = queries.select("query_id", "topic", F.explode(F.array_distinct("terms")).alias("term")).withColumn("weight", weight("term", long))
        wanted = self.asked.select("term").distinct()
        self.postings = docs.select("doc_id", "boost", F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi")

    def champions(self) -> DataFrame:
        order = W.partitionBy("term").orderBy(F.desc("boost"), "doc_id")
        return self.postings.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= CHAMPIONS).select("term", "doc_id")

    def scored(self, pairs: DataFrame, least: int) -> DataFrame:
        """query_id, doc_id, source, score, prefer of pairs whose terms weigh ``least`` or more."""
        terms = pairs.join(self.asked, "query_id").join(self.postings.select("term", "doc_id"), ["term", "doc_id"])
        base = terms.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("base"), F.first("topic").alias("asked_topic")).filter(F.col("base") >= least)
        facts = self.docs.select("doc_id", "source", "topic", "boost", "prefer")
        same = F.when(F.col("topic") == F.col("asked_topic"), self.topic_boost).otherwise(0)
        return base.join(facts, "doc_id").select("query_id", "doc_id", "source", (F.col("base") + F.col("boost") + same).alias("score"), "prefer")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, one of each source, with ``rank``."""
    order = [F.desc("score"), F.desc("prefer"), F.asc("doc_id")]
    one = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id", "source").orderBy(*order))).filter("r = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).drop("r")


def candidates(index: TermIndex, k: int, least: int) -> DataFrame:
    """query_id, doc_id of every document that may be among the k best, and few others."""
    seeds = index.asked.join(index.champions(), "term").select("query_id", "doc_id").distinct()
    bounds = best(index.scored(seeds, least), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    sizes = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    most = index.docs.agg(F.coalesce(F.max("boost"), F.lit(0)).alias("most"))
    rest = W.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
    terms = index.asked.join(sizes, "term").withColumn("rest", F.sum("weight").over(rest)).join(bounds, "query_id", "left").crossJoin(F.broadcast(most))  # one row
    # terms whose weights, with those of all more frequent ones, reach both gates
    read = terms.filter((F.col("rest") >= least) & (F.col("rest") + F.col("most") + index.topic_boost >= F.coalesce("bound", F.lit(0))))
    return read.select("query_id", "term").join(index.postings.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct()


def top_matches(queries: DataFrame, docs: DataFrame, k: int, least: int, long: int, topic_boost: int = 0) -> DataFrame:
    """query_id, doc_id, source, score, prefer, rank."""
    index = TermIndex(docs, queries, long, topic_boost)
    return best(index.scored(candidates(index, k, least), least), k)


def snippet(text: Column | str, terms: Column | str, before: int, size: int) -> Column:
    """The text around the earliest of the terms, its white space squeezed; from the start where none stands."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(plain), t)), lambda p: p > 0)
    return F.substring(plain, F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - before), F.lit(size))
