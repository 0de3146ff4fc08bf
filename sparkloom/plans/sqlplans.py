"""Operators that one SQL text expresses, or a Spark and a DuckDB text where the dialects differ.

Tables stand in braces; Spark binds them to DataFrames, DuckDB knows them by name. Sorting keys are
explicit everywhere, as no result may hang on the order of partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkloom.registry import ORACLES, QUERIES, load

_TABLE = re.compile(r"\{(\w+)\}")
#: Spark's and DuckDB's text of each query.
TEXTS: dict[str, tuple[str, str]] = {}


def plan(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query given as SQL, and its oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in set(_TABLE.findall(sql))})

    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    TEXTS[name] = (sql, duck or sql)
    QUERIES[name] = run
    ORACLES[name] = _TABLE.sub(r"\1", duck or sql)


# documents: filters, fingerprints, deduplication, caps, budgets
plan("doc_min_length_filter", "SELECT doc_id, length(text) AS n FROM {documents} WHERE length(text) >= 200")
plan("doc_fingerprint_sha1", "SELECT doc_id, sha1(concat(source, chr(10), lang, chr(10), text)) AS fingerprint FROM {documents}")
plan("doc_short_digest", "SELECT doc_id, substring(sha2(text, 256), 1, 16) AS digest FROM {documents}", "SELECT doc_id, substring(sha256(text), 1, 16) AS digest FROM documents")
plan("doc_exact_dedup_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM {documents}) t WHERE r = 1")
plan("doc_dedup_last_wins", "SELECT md5(text) AS k, max(doc_id) AS doc_id FROM {documents} GROUP BY md5(text)")
plan("doc_duplicate_count", "SELECT count(*) - count(DISTINCT md5(text)) AS duplicates FROM {documents}")
plan("doc_source_caps", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {documents}) t WHERE r <= 20")
plan("doc_clean_whitespace", r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '\r\n', '\n'), '[ \t]+\n', '\n'), '\n\n\n\n+', '\n\n\n')) AS h FROM {documents}", "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n\\n\\n\\n+', chr(10) || chr(10) || chr(10), 'g')) AS h FROM documents")
plan("doc_title_fallback", "SELECT doc_id, coalesce(nullif(split_part(text, chr(10), 1), ''), concat('doc-', doc_id)) AS title FROM {documents}", "SELECT doc_id, coalesce(nullif(split_part(text, chr(10), 1), ''), 'doc-' || doc_id) AS title FROM documents")
plan("doc_first_sentences", "SELECT doc_id, CASE WHEN p > 120 THEN substring(head, 1, p) ELSE head END AS summary FROM (SELECT doc_id, head, CASE WHEN instr(head, '.') = 0 THEN 0 ELSE 301 - instr(reverse(rpad(head, 300, ' ')), '.') END AS p FROM (SELECT doc_id, substring(replace(text, chr(10), ' '), 1, 300) AS head FROM {documents}) a) b")
plan("doc_sections_by_line", "SELECT doc_id, posexplode(split(text, '\\n')) AS (line, body) FROM {documents}".replace("\\n", "\\n"), "SELECT doc_id, (unnest(range(len(s))))::INT AS line, unnest(s) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) t")
plan("stats_by_source", "SELECT source, count(*) AS n, sum(n_chars) AS chars, min(n_chars) AS least, max(n_chars) AS most FROM {documents} GROUP BY source", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
plan("length_percentiles", "SELECT lang, round(percentile(n_chars, 0.5), 3) AS p50, round(percentile(n_chars, 0.9), 3) AS p90, round(avg(n_chars), 3) AS mean FROM {documents} GROUP BY lang", "SELECT lang, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.9), 3) AS p90, round(avg(n_chars), 3) AS mean FROM documents GROUP BY lang")
plan("top20_counts", "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang ORDER BY n DESC, source, lang LIMIT 20")
plan("union_mix", "SELECT 0 AS ord, doc_id AS id, md5(text) AS h FROM {documents} UNION ALL SELECT 1, item_id, md5(text) FROM {benchmark}")
plan("source_share", "SELECT source, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 9) AS share FROM {documents} GROUP BY source")
plan("anti_join_exclude", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
plan("semi_join_wanted", "SELECT d.doc_id, d.source FROM {documents} d LEFT SEMI JOIN {labels} l ON d.doc_id = l.doc_id AND l.quality = 1", "SELECT d.doc_id, d.source FROM documents d SEMI JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
plan("hash_sample_sorted", "SELECT doc_id FROM (SELECT doc_id FROM {documents} ORDER BY md5(concat('s|', doc_id)), doc_id LIMIT 50) t ORDER BY doc_id")
plan("weighted_replication", "SELECT doc_id, explode(sequence(1, 1 + quality + 2 * toxic)) AS copy FROM {labels}", "SELECT doc_id, unnest(range(1, 2 + quality + 2 * toxic))::INT AS copy FROM labels")
plan("keep_latest_k", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) t WHERE r <= 3")
plan("repeat_epoch_sampling", "SELECT g.d, t.doc_id FROM (SELECT doc_id, p.pass, row_number() OVER (PARTITION BY p.pass ORDER BY md5(concat(p.pass, '|', doc_id)), doc_id) - 1 AS r, count(*) OVER (PARTITION BY p.pass) AS n FROM (SELECT doc_id FROM {labels} WHERE toxic = 1) x CROSS JOIN (SELECT 0 AS pass UNION ALL SELECT 1 UNION ALL SELECT 2) p) t JOIN (SELECT 0 AS d) g ON t.r >= g.d WHERE t.pass * t.n + t.r < 2 * t.n + 5")

# prepared samples: frames, offsets, counters, fits
_SAMPLES = "SELECT doc_id, size(split(split_part(text, chr(10), 1), ' ')) AS i, size(split(text, ' ')) AS r, source FROM {documents}"
_DUCK_SAMPLES = "SELECT doc_id, len(string_split(split_part(text, chr(10), 1), ' ')) AS i, len(string_split(text, ' ')) AS r, source FROM documents"


def sample_plan(name: str, head: str) -> None:
    cast = head.replace("#", "")
    plan(name, cast.replace("@S", f"({_SAMPLES})"), f"SELECT * FROM ({cast.replace('@S', f'({_DUCK_SAMPLES})')}) z")


sample_plan("prepare_samples", "SELECT doc_id, CAST(3 + i + r + 1 AS BIGINT) AS sample_len, CASE WHEN 3 + i + r + 1 <= 1024 THEN 'kept' WHEN 1024 - (r + 1) - 3 > 0 THEN 'truncated' ELSE 'dropped' END AS fate FROM @S s")
sample_plan("prepare_drop_counters", "SELECT count(*) AS total, CAST(sum(CASE WHEN 4 + i + r > 1024 THEN 1 ELSE 0 END) AS BIGINT) AS over, CAST(sum(CASE WHEN 1024 - r - 4 <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_room, CAST(max(4 + i + r) AS BIGINT) AS longest FROM @S s")
sample_plan("context_fit_filter", "SELECT doc_id, CAST(least(r, 512 - least(i, 512)) AS BIGINT) AS kept FROM @S s WHERE r >= 4 AND 512 - least(i, 512) > 0")
sample_plan("merge_offsets", "SELECT source, CAST(sum(t) OVER (ORDER BY source) - t AS BIGINT) AS base FROM (SELECT source, sum(4 + i + r) AS t FROM @S s GROUP BY source) g")
plan("cu_seqlens", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) AS BIGINT) AS starts FROM {conversations}")

# conversations
plan("convo_role_normalize", "SELECT conv_id, turn, CASE lower(role) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'tool' END AS role FROM {conversations}")
plan("convo_final_assistant", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {conversations} WHERE role = 'assistant') t WHERE r = 1")
plan("convo_example_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS example_index FROM {conversations} WHERE role = 'assistant' AND turn > 0")
plan("convo_last_of_role", "SELECT conv_id, role, max_by(md5(text), turn) AS h FROM {conversations} GROUP BY conv_id, role", "SELECT conv_id, role, arg_max(md5(text), turn) AS h FROM conversations GROUP BY conv_id, role")
plan("convo_flatten_messages", "SELECT conv_id, array_join(transform(array_sort(collect_list(named_struct('turn', turn, 'line', concat(role, ': ', text)))), x -> x.line), '\\n') AS body FROM {conversations} GROUP BY conv_id", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")

# evaluation: predictions are made from hashes of labelled rows
_VOTES = "SELECT l.doc_id, d.source AS subject, l.quality + 1 AS gold, CASE WHEN d.n_chars % 7 = 0 THEN NULL ELSE CAST(d.n_chars % 4 + 1 AS INT) END AS pred FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
plan("mcq_accuracy_by_group", f"SELECT coalesce(subject, 'all') AS subject, count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(avg(CASE WHEN pred IS NULL THEN 0e0 ELSE 1e0 END), 9) AS parse_rate FROM ({_VOTES}) v GROUP BY ROLLUP(subject)")
plan("guess_credit_accuracy", f"SELECT round(avg(CASE WHEN pred IS NULL THEN 0.25 WHEN pred = gold THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM ({_VOTES}) v")
plan("macro_average", f"SELECT round(avg(acc), 9) AS macro, count(*) AS n FROM (SELECT subject, avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END) AS acc FROM ({_VOTES}) v GROUP BY subject) g")
plan("majority_vote", "SELECT l_orderkey, vote FROM (SELECT l_orderkey, vote, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, vote) AS r FROM (SELECT l_orderkey, CAST(l_quantity % 5 AS INT) AS vote, count(*) AS n, min(l_linenumber) AS seen FROM {lineitem} GROUP BY l_orderkey, CAST(l_quantity % 5 AS INT)) c) t WHERE r = 1")
plan("pass_at_k", "SELECT l_orderkey, round(CASE WHEN n - c < 2 THEN 1.0 ELSE 1.0 - (1.0 * (n - c) / n) * (1.0 * (n - c - 1) / (n - 1)) END, 9) AS pass2 FROM (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS c FROM {lineitem} GROUP BY l_orderkey) t WHERE n >= 2".replace("1.0", "CAST(1 AS DOUBLE)"))
plan("weighted_mean_reduce", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS m FROM {lineitem} GROUP BY l_returnflag")
plan("lr_schedule", "SELECT s, round(CASE WHEN s < 10 THEN s / 10.0D ELSE 0.1D + 0.45D * (1 + cos(pi() * (s - 10) / 90.0D)) END, 9) AS lr FROM (SELECT explode(sequence(0, 100)) AS s) t", "SELECT s, round(CASE WHEN s < 10 THEN s / 10.0::DOUBLE ELSE 0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * (s - 10) / 90.0::DOUBLE)) END, 9) AS lr FROM (SELECT unnest(range(0, 101))::INT AS s) t")
plan("fewshot_by_group", "SELECT q.doc_id, s.r, s.shot FROM (SELECT doc_id, source FROM {documents}) q JOIN (SELECT source, doc_id AS shot, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {documents}) s ON q.source = s.source WHERE s.r <= 3 AND s.shot <> q.doc_id")
plan("segment_sums", "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS hits, min(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS exact FROM {lineitem} GROUP BY l_orderkey", "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS hits, min(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS exact FROM lineitem GROUP BY l_orderkey")
plan("answer_left_join_last_wins", "SELECT c.c_custkey, coalesce(o.last_status, '') AS answer FROM {customer} c LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS last_status FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey", "SELECT c.c_custkey, coalesce(o.last_status, '') AS answer FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
plan("qa_count_grid", "SELECT n.n_name, s.st, coalesce(a.c, 0) AS c, coalesce(a.c, 0) NOT IN (0, 60) AS issue FROM {nation} n CROSS JOIN (SELECT 'F' AS st UNION ALL SELECT 'O' UNION ALL SELECT 'P') s LEFT JOIN (SELECT c_nationkey, o_orderstatus, count(*) AS c FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderstatus) a ON a.c_nationkey = n.n_nationkey AND a.o_orderstatus = s.st")
plan("required_files_complete", "SELECT o_custkey, size(array_except(array('F', 'O', 'P'), collect_set(o_orderstatus))) = 0 AS complete FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, count(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) = 3 AS complete FROM orders GROUP BY o_custkey")
plan("asof_version", "SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS version FROM {orders} WHERE o_orderdate <= timestamp '1997-06-30 00:00:00' GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders WHERE o_orderdate <= timestamp '1997-06-30 00:00:00' GROUP BY o_custkey")
plan("prefix_config_first_match", "SELECT p_partkey, coalesce(cap, 7) AS cap FROM (SELECT p.p_partkey, c.cap, row_number() OVER (PARTITION BY p.p_partkey ORDER BY c.ord NULLS LAST) AS r FROM {part} p LEFT JOIN (SELECT 1 AS ord, 'a' AS pre, 10 AS cap UNION ALL SELECT 2, 'al', 20 UNION ALL SELECT 3, 'b', 30) c ON substring(p.p_name, 1, length(c.pre)) = c.pre) t WHERE r = 1")

# overlap with held-out texts and retrieval
plan("entity_match_alias", "SELECT doc_id, name FROM (SELECT d.doc_id, a.name, row_number() OVER (PARTITION BY d.doc_id ORDER BY a.ord) AS r FROM {documents} d JOIN (SELECT 1 AS ord, 'license' AS name UNION ALL SELECT 2, 'token' UNION ALL SELECT 3, 'rights') a ON instr(lower(d.text), a.name) > 0) t WHERE r <= 2")
plan("snippet_window", "SELECT doc_id, substring(text, greatest(1, p - 40), 120) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'license') AS p FROM {documents}) t WHERE p > 0")
plan("leak_scan", "SELECT count(*) AS leaks FROM {documents} WHERE regexp_like(lower(text), 'official answer|answer key')", "SELECT count(*) AS leaks FROM documents WHERE regexp_matches(lower(text), 'official answer|answer key')")

# pages
plan("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}")
plan("html_links", "SELECT page_id, explode(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM {pages}", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
plan("html_strip_text", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' '), '(?s)<[^>]*>', ' '), '[ \\\\t\\\\r\\\\n]+', ' '))) AS h FROM {pages}", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS h FROM pages")

# literal rows for branches that the tables never reach
plan("think_strip", "SELECT k, trim(regexp_replace(x, '(?is)<think>.*?</think>[ \\\\n]*', '')) AS y FROM VALUES (1, '<THINK>a\\nb</think>\\n answer'), (2, '<think>x</think>  '), (3, 'plain') AS t(k, x)", "SELECT k, trim(regexp_replace(x, '(?is)<think>.*?</think>[ \\n]*', '', 'g')) AS y FROM (VALUES (1, '<THINK>a' || chr(10) || 'b</think>' || chr(10) || ' answer'), (2, '<think>x</think>  '), (3, 'plain')) AS t(k, x)")
plan("condition_normalize", "SELECT k, CASE WHEN x LIKE '%cot%' THEN 'cot' WHEN x LIKE '%synth%' THEN 'synth' WHEN x LIKE '%noisy%' THEN 'noisy' ELSE 'direct' END AS c FROM (SELECT 1 AS k, 'synth,cot' AS x UNION ALL SELECT 2, 'noisy,direct' UNION ALL SELECT 3, 'weird') t")
plan("parse_answer", "SELECT k, coalesce(nullif(regexp_extract(substring(x, 1, 120), 'answer: *([1-5])', 1), ''), nullif(regexp_extract(substring(x, 1, 60), '([1-5])', 1), '')) AS pred FROM (SELECT 1 AS k, 'so 4 but answer: 2' AS x UNION ALL SELECT 2, 'I take 3' UNION ALL SELECT 3, concat(repeat('x', 60), '5')) t")
plan("last_option_letter", "SELECT k, coalesce(element_at(regexp_extract_all(x, '[(]([A-J])[)]', 1), -1), element_at(regexp_extract_all(x, '([A-J])', 1), -1)) AS letter FROM VALUES (1, 'A or (B) or (C) D'), (2, 'say E') AS t(k, x)".replace("element_at(", "try_element_at("), "SELECT k, coalesce(regexp_extract_all(x, '[(]([A-J])[)]', 1)[-1], regexp_extract_all(x, '([A-J])', 1)[-1]) AS letter FROM (VALUES (1, 'A or (B) or (C) D'), (2, 'say E')) AS t(k, x)")
plan("numeric_truth", "SELECT k, CAST(CAST(replace(trim(split_part(x, '####', 2)), ',', '') AS DOUBLE) AS BIGINT) AS truth FROM (SELECT 1 AS k, 'so #### 1,234' AS x UNION ALL SELECT 2, 'then #### 7') t")
plan("sql_table_names", "SELECT k, transform(regexp_extract_all(lower(q), '(?:from|join) +([a-z_.]+)', 1), x -> element_at(split(x, '[.]'), -1)) AS names FROM VALUES (1, 'SELECT * FROM a.b JOIN c ON 1'), (2, 'select 1') AS t(k, q)", "SELECT k, list_transform(regexp_extract_all(lower(q), '(?:from|join) +([a-z_.]+)', 1), lambda x: string_split(x, '.')[-1]) AS names FROM (VALUES (1, 'SELECT * FROM a.b JOIN c ON 1'), (2, 'select 1')) AS t(k, q)")
plan("cloze_first_term", "SELECT item_id, regexp_replace(text, '^([^ ]+)', '[blank]') AS body FROM {benchmark}")
plan("mcq_render", "SELECT k, array_join(transform(c, (x, i) -> concat(char(65 + i), '. ', x)), '\\n') AS body FROM VALUES (1, array('red', 'blue')), (2, array('one', 'two', 'three')) AS t(k, c)", "SELECT k, array_to_string(list_transform(c, lambda x, i: chr((64 + i)::INT) || '. ' || x), chr(10)) AS body FROM (VALUES (1, ['red', 'blue']), (2, ['one', 'two', 'three'])) AS t(k, c)")
plan("text2sql_normalize", "SELECT sha1(concat(s, chr(10), q, chr(10), a)) AS fingerprint, concat_ws('\\n', concat('Dialect: ', d), concat('Schema:\\n', s), concat('Question: ', q), 'SQL:') AS instruction, a AS response FROM VALUES ('CREATE TABLE t (a INT)', 'how many?', 'SELECT count(*) FROM t', 'duckdb') AS t(s, q, a, d) WHERE trim(q) <> '' AND trim(a) <> ''", "SELECT sha1(s || chr(10) || q || chr(10) || a) AS fingerprint, concat_ws(chr(10), 'Dialect: ' || d, 'Schema:' || chr(10) || s, 'Question: ' || q, 'SQL:') AS instruction, a AS response FROM (VALUES ('CREATE TABLE t (a INT)', 'how many?', 'SELECT count(*) FROM t', 'duckdb')) AS t(s, q, a, d) WHERE trim(q) <> '' AND trim(a) <> ''")
plan("circled_digits", "SELECT translate(x, '①②③④⑤', '12345') AS y FROM (SELECT '①' AS x UNION ALL SELECT '③, ⑤') t")

# batch forms of the event streams
plan("stream_tumbling_counts", "SELECT date_trunc('HOUR', ts) AS start, event_type, count(*) AS n FROM {events} GROUP BY date_trunc('HOUR', ts), event_type", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
plan("stream_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '6' HOUR THEN 0 ELSE 1 END AS new FROM {events}) a) b GROUP BY user_id, s")
plan("props_json", "SELECT event_id, length(props) AS n FROM {events} WHERE props IS NOT NULL")
