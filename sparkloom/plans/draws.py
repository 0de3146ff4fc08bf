"""Draws that go on over epochs, and picks by the largest deficit, as arithmetic on places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.accept import accepted
from sparkloom.operators.asof import asof_join, with_pinned
from sparkloom.plans.dialects import both, ring, running, spell
from sparkloom.registry import load, query

#: Epochs of the draws below.
EPOCHS = 3

# each source gives least(cap, n) * repeat rows an epoch; its cursor runs on through as many permutations as that takes
_TASKS = "SELECT coalesce(source, '') AS task, count(*) AS n, CASE WHEN coalesce(source, '') LIKE 'src1%' THEN 3 * least(7, count(*)) ELSE 2 * count(*) END AS want FROM {documents} GROUP BY coalesce(source, '')"
_PASSES = f"SELECT task, n, want, @each(@seq(0, CAST(floor(({EPOCHS} * want - 1) / CAST(n AS DOUBLE)) AS BIGINT))) AS pass FROM ({_TASKS}) t"
_DRAWN = f"SELECT d.doc_id, p.task, p.n, p.want, p.pass, concat(p.task, '|', p.pass) AS grp, concat(p.pass, '|', d.doc_id) AS k FROM {{documents}} d JOIN ({_PASSES}) p ON coalesce(d.source, '') = p.task"
both(
    "cursor_epochs",
    f"SELECT CAST(floor(draw / CAST(want AS DOUBLE)) AS BIGINT) AS epoch, task, CAST(draw % want AS BIGINT) AS place, pass, doc_id FROM (SELECT *, pass * n + pos AS draw FROM ({ring(_DRAWN, 'grp', 'k', 'cursor')}) r) q WHERE draw < {EPOCHS} * want",
)


def _picks(*targets: tuple[str, int]) -> str:
    """name, k and before: the number of each group's k-th pick when the largest relative deficit, (target - k) / target, goes first."""
    values = " UNION ALL ".join(f"SELECT {o} AS ord, '{name}' AS name, {n} AS target" for o, (name, n) in enumerate(targets))
    steps = f"SELECT ord, name, k, CAST(k AS DOUBLE) / target AS share, 0 AS whole, 1 AS one FROM (SELECT ord, name, target, @each(@seq(0, target - 1)) AS k FROM ({values}) v) s"
    return running(steps, "whole", "share, ord", "one", "CAST(floor(share * 64) AS INT)")


_POOL = ring("SELECT doc_id, lang FROM {documents}", "lang", "doc_id", "deficit")
both(
    "deficit_picks",
    f"SELECT s.before AS pick, s.name AS lang, t.name AS kind, d.doc_id FROM ({_picks(('en', 40), ('de', 25), ('fr', 15), ('es', 9))}) s "
    f"JOIN ({_picks(('negative', 50), ('cloze', 26), ('reference', 13))}) t ON t.before = s.before JOIN ({_POOL}) d ON d.lang = s.name AND d.pos = s.k",
)

DATES = ("1995-09-30", "1996-06-30", "1998-01-01", "1999-03-31")


@query(
    "asof_order_versions",
    f"""WITH a AS (SELECT c_custkey, CAST(unnest({list(DATES)}) AS TIMESTAMP) AS as_of FROM customer),
v AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'),
p AS (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderdate, o_orderkey) AS o_orderdate, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey),
f AS (SELECT c_custkey, as_of, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS found FROM a LEFT JOIN v ON v.o_custkey = c_custkey AND v.o_orderdate <= as_of GROUP BY ALL)
SELECT c_custkey, CAST(as_of AS DATE) AS as_of, coalesce(found, CASE WHEN p.o_orderstatus = 'F' AND p.o_orderdate <= as_of THEN p.o_orderkey END) AS version,
       found IS NULL AND coalesce(p.o_orderstatus = 'F' AND p.o_orderdate <= as_of, false) AS is_pinned FROM f LEFT JOIN p ON p.o_custkey = c_custkey""",
)
def asof_order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest open order at four dates; where none, the first order, if that is finished and was there by then."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey", "o_orderstatus")
    asks = load(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*(F.to_timestamp(F.lit(d)) for d in DATES))).alias("as_of"))
    found = asof_join(asks, orders.filter("o_orderstatus <> 'F'"), "c_custkey", "as_of", "o_orderdate", "o_orderkey")
    first = orders.groupBy("c_custkey").agg(F.min(F.struct("o_orderkey", "o_orderdate", "o_orderstatus")).alias("x")).select("c_custkey", "x.*")
    rows = with_pinned(found, first, "c_custkey", "as_of", "o_orderdate", "o_orderstatus", "F")
    return rows.select("c_custkey", F.to_date("as_of").alias("as_of"), F.col("version.o_orderkey").alias("version"), "is_pinned")


_LIMITS = (("en", 40), ("de", 15), ("fr", 10), ("es", 10))


@query("accept_snippets")
def accept_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of documents, six of each at most, accepted up to a quota by language unless too like a held-out item."""
    docs = load(spark, sf_dir, "documents")
    sentences = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), r"(?<=[.]) +"), lambda s: F.length(s).between(28, 240) & (F.length(F.replace(s, F.lit("("))) == F.length(F.replace(s, F.lit(")")))))
    snippets = docs.select("doc_id", F.col("lang").alias("grp"), F.posexplode(F.slice(F.array_distinct(sentences), 1, 6)).alias("k", "text")).withColumn("candidate_id", F.col("doc_id") * 8 + F.col("k"))
    placed = spark.sql(spell(ring("SELECT candidate_id, grp, text FROM {rows}", "grp", "candidate_id", "accept"), 0), rows=snippets)
    quotas = spark.createDataFrame(_LIMITS, "grp string, quota int")
    found = accepted(placed.select("candidate_id", "grp", "text", F.col("pos").alias("place")), load(spark, sf_dir, "benchmark"), quotas, 0.8)
    return found.select("candidate_id", "grp", F.round("similarity", 6).alias("similarity"))
