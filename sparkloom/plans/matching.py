"""Documents against held-out items: overlap of word sets, ranked retrieval, and names from an alias table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import aliases, retrieval, setjoin
from sparkloom.registry import ORACLES, load, query

#: Fewest letters of a word that counts; a retrieval term of this many weighs two.
WORD, LONG_TERM = 6, 8
OVERLAP = 0.5


def words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= WORD))


_SETS = "SELECT DISTINCT {0} AS id, w FROM (SELECT {0}, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM {1}) x WHERE length(w) >= 6"
_D, _B = _SETS.format("doc_id", "documents"), _SETS.format("item_id", "benchmark")


@query(
    "decontaminate_token_overlap",
    f"""SELECT m.doc_id, m.item_id, round(CAST(m.n AS DOUBLE) / least(a.n, b.n), 9) AS overlap
FROM (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n FROM ({_D}) d JOIN ({_B}) q ON d.w = q.w GROUP BY d.id, q.id) m
JOIN (SELECT id, count(*) AS n FROM ({_D}) x GROUP BY id) a ON a.id = m.doc_id
JOIN (SELECT id, count(*) AS n FROM ({_B}) y GROUP BY id) b ON b.id = m.item_id
WHERE CAST(m.n AS DOUBLE) / least(a.n, b.n) >= {OVERLAP}""",
)
def decontaminate_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and item whose longer words overlap by half of the smaller set."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), words("text").alias("words"))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("id"), words("text").alias("words"))
    pairs = setjoin.overlap_join(docs, items, OVERLAP)
    return pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.round("overlap", 9).alias("overlap"))


_SCORE = f"SELECT q.id AS item_id, d.id AS doc_id, CAST(sum(CASE WHEN length(d.w) >= {LONG_TERM} THEN 2 ELSE 1 END) AS BIGINT) AS base FROM ({_D}) d JOIN ({_B}) q ON d.w = q.w GROUP BY q.id, d.id"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, docs = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents")
    topics = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    queries = items.select(F.col("item_id").alias("query_id"), words("text").alias("terms"), topics.alias("topic"))
    return queries, docs.select("doc_id", "text", words("text").alias("terms"), "source", F.col("lang").alias("topic"))


@query("retrieve_topk_terms", f"SELECT item_id, doc_id, base AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY base DESC, doc_id) AS r FROM ({_SCORE}) s WHERE base >= 3) t WHERE r <= 5")
def retrieve_topk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of each item that share the most terms, long ones counting twice."""
    queries, docs = _sides(spark, sf_dir)
    plain = docs.select("doc_id", "terms", F.col("doc_id").alias("source"), "topic", F.lit(0).alias("boost"), F.lit(False).alias("prefer"))
    return retrieval.top_matches(queries, plain, k=5, least=3, long=LONG_TERM).select(F.col("query_id").alias("item_id"), "doc_id", "score")


_TOPIC = "CASE q.item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END"
_PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "retrieve_ranked_contexts",
    f"""WITH s AS ({_SCORE}),
t AS (SELECT s.item_id, s.doc_id, d.source, d.source = 'src1' AS prefer, base + CASE WHEN d.source = 'src1' THEN 3 ELSE 0 END + CASE WHEN d.lang = {_TOPIC} THEN 4 ELSE 0 END AS score
      FROM s JOIN documents d ON d.doc_id = s.doc_id JOIN benchmark q ON q.item_id = s.item_id WHERE base >= 3),
u AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, prefer DESC, doc_id) AS r FROM t),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, prefer DESC, doc_id) AS INTEGER) AS rank FROM u WHERE r = 1),
h AS (SELECT v.item_id, v.doc_id, min(instr(lower(p.plain), w)) AS at FROM v JOIN (SELECT doc_id, {_PLAIN} AS plain FROM documents) p ON p.doc_id = v.doc_id JOIN ({_B}) b ON b.id = v.item_id
      WHERE rank <= 3 AND instr(lower(p.plain), w) > 0 GROUP BY v.item_id, v.doc_id)
SELECT v.item_id, v.rank, v.doc_id, v.score, substr({_PLAIN}, greatest(1, coalesce(h.at, 1) - 80), 420) AS snippet
FROM v JOIN documents d ON d.doc_id = v.doc_id LEFT JOIN h ON h.item_id = v.item_id AND h.doc_id = v.doc_id WHERE rank <= 3""",
)
def retrieve_ranked_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contexts of each item from different sources: one source is preferred, the item's language counts more, the text around the first term."""
    queries, docs = _sides(spark, sf_dir)
    prefer = F.coalesce(F.col("source") == "src1", F.lit(False))
    facts = docs.select("doc_id", "terms", "source", "topic", F.when(prefer, 3).otherwise(0).alias("boost"), prefer.alias("prefer"))
    found = retrieval.top_matches(queries, facts, k=3, least=3, long=LONG_TERM, topic_boost=4).select("query_id", "rank", "doc_id", "score")
    full = found.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "terms"), "query_id")
    return full.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score", retrieval.snippet("text", "terms", 80, 420).alias("snippet"))


_ALIASES = "SELECT row_number() OVER (ORDER BY length(w) DESC, w) AS ord, w AS alias, 'item ' || CAST(min(id) AS VARCHAR) AS canonical FROM ({0}) x WHERE length(w) >= 9 GROUP BY w"


@query(
    "entity_names",
    f"""WITH a AS ({_ALIASES.format(_B)}),
f AS (SELECT doc_id, canonical, min(ord) AS ord FROM documents JOIN a ON instr(lower(regexp_replace(text, '\\s+', '', 'g')), alias) > 0 GROUP BY doc_id, canonical),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM f)
SELECT d.doc_id, coalesce(x.names, CASE WHEN lang = 'en' THEN 'item 1|item 2' ELSE 'item 3' END) AS names
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(canonical, '|' ORDER BY ord) AS names FROM r WHERE r <= 5 GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
)
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items whose longest words a text holds, white space aside: five at most, in the order of the alias table, else a fallback by language."""
    items = load(spark, sf_dir, "benchmark").select("item_id", F.explode(words("text")).alias("w")).filter(F.length("w") >= 9)
    # one row per distinct long word of the held-out items, numbered in one task as their order is one list
    table = items.groupBy("w").agg(F.min("item_id").alias("item"))
    table = table.select(F.expr("row_number() OVER (ORDER BY length(w) DESC, w)").alias("ord"), F.col("w").alias("alias"), F.concat(F.lit("item "), "item").alias("canonical"))
    fallback = F.when(F.col("lang") == "en", F.array(F.lit("item 1"), F.lit("item 2"))).otherwise(F.array(F.lit("item 3")))
    return aliases.entities(load(spark, sf_dir, "documents"), table, "lang", fallback).select("doc_id", F.array_join("names", "|").alias("names"))


_LEAKS = ("official answer", "answer key", "password")
_FOUND = ORACLES["retrieve_ranked_contexts"]


@query(
    "retrieval_kept_contexts",
    f"SELECT item_id, rank, doc_id, score FROM ({_FOUND}) f JOIN (SELECT doc_id, text, source FROM documents) d USING (doc_id) WHERE score >= 4 AND source <> 'src7' AND NOT regexp_matches(lower(text), '{'|'.join(_LEAKS)}')",
)
def retrieval_kept_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved contexts without those of an excluded source, of a low score, or whose document speaks of answers."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = retrieve_ranked_contexts(spark, sf_dir).filter("score >= 4").join(docs, "doc_id").filter((F.col("source") != "src7") & ~F.lower("text").rlike("|".join(_LEAKS)))
    return kept.select("item_id", "rank", "doc_id", "score")


_SHOTS = 2


@query(
    "rag_prompt_messages",
    f"""WITH c AS (SELECT item_id, string_agg('[' || rank || '] ' || snippet, chr(10) ORDER BY rank) AS context FROM ({_FOUND}) f GROUP BY item_id),
s AS (SELECT string_agg('[user]' || chr(10) || text || chr(10) || '[assistant]' || chr(10) || length(text), chr(10) ORDER BY item_id) AS shots FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT {_SHOTS}) x)
SELECT b.item_id, c.context IS NOT NULL AS has_context, md5('[system]' || chr(10) || 'Answer by number.' || chr(10) || s.shots || chr(10) || '[user]' || chr(10) || coalesce('Context:' || chr(10) || c.context || chr(10) || chr(10), '') || b.text) AS messages_md5
FROM benchmark b CROSS JOIN s LEFT JOIN c ON c.item_id = b.item_id WHERE b.item_id NOT IN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT {_SHOTS})""",
)
def rag_prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each item: the system's, the first items as worked examples, then the item behind its retrieved contexts."""
    items = load(spark, sf_dir, "benchmark").select("item_id", "text")
    shots = items.orderBy("item_id").limit(_SHOTS)  # a few rows, which go to all
    told = F.concat(F.lit("[user]\n"), "text", F.lit("\n[assistant]\n"), F.length("text"))
    one = shots.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", told.alias("m")))), lambda x: x["m"]), "\n").alias("shots"))
    line = F.concat(F.lit("["), "rank", F.lit("] "), "snippet")
    contexts = retrieve_ranked_contexts(spark, sf_dir).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("m")))), lambda x: x["m"]), "\n").alias("context"))
    rows = items.join(F.broadcast(shots.select("item_id")), "item_id", "left_anti").join(contexts, "item_id", "left").crossJoin(F.broadcast(one))
    context = F.coalesce(F.concat(F.lit("Context:\n"), "context", F.lit("\n\n")), F.lit(""))
    message = F.concat(F.lit("[system]\nAnswer by number.\n"), "shots", F.lit("\n[user]\n"), context, "text")
    return rows.select("item_id", F.col("context").isNotNull().alias("has_context"), F.md5(message).alias("messages_md5"))
