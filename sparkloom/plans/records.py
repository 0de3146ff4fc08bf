"""Record builders, predicates, generators and scalar rules in one text for both dialects.

A word led by @ names a function that the dialects call differently; see dialects.py.
"""

from __future__ import annotations

from sparkloom.plans.dialects import both
from sparkloom.plans.sqlplans import plan

# aggregates
both("chars_per_token", "SELECT lang, round(sum(length(text)) / CAST(sum(@len(@split(text, ' '))) AS DOUBLE), 9) AS chars_per_token FROM {documents} GROUP BY lang")
both(
    "token_estimate",
    "SELECT source, CAST(sum(b) AS BIGINT) AS bytes, round(CAST(sum(CASE WHEN r <= 10 THEN n ELSE 0 END) AS DOUBLE) * sum(b) / sum(CASE WHEN r <= 10 THEN b ELSE 0 END), 3) AS tokens "
    "FROM (SELECT source, @bytes(text) AS b, @len(@split(text, ' ')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {documents}) t GROUP BY source",
)
both("packing_efficiency", "SELECT source, round(CAST(sum(n) AS DOUBLE) / (ceil(sum(n) / 2048e0) * 2048e0), 9) AS used, CAST(round(sum(n) / 24576e0) AS BIGINT) AS batches FROM (SELECT source, @len(@split(text, ' ')) AS n FROM {documents}) t GROUP BY source")
both("merge_compatibility", "SELECT source, count(DISTINCT lang) = 1 AS compatible FROM {documents} GROUP BY source")
both("status_table", "SELECT concat('| ', source, ' | ', count(*), ' | ', CAST(sum(n_chars) AS BIGINT), ' |') AS line FROM {documents} GROUP BY source")
both(
    "majority_in_top_k",
    "SELECT l_orderkey, max(CASE WHEN r <= 2 AND vote = l_orderkey % 5 THEN 1 ELSE 0 END) AS hit FROM (SELECT l_orderkey, vote, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, vote) AS r "
    "FROM (SELECT l_orderkey, CAST(l_quantity % 5 AS INT) AS vote, count(*) AS n, min(l_linenumber) AS seen FROM {lineitem} GROUP BY l_orderkey, CAST(l_quantity % 5 AS INT)) c) t GROUP BY l_orderkey",
)

# records
both("condition_by_content", "SELECT conv_id, turn, CASE WHEN contains(lower(text), '<think>') THEN 'cot' ELSE 'direct' END AS condition FROM {conversations} WHERE role = 'assistant'")
both("stable_row_id", "SELECT p_partkey, concat_ws('_', 'part', concat('r', lpad(CAST(p_size AS STRING), 3, '0')), lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-'@all))) AS row_id FROM {part}")
both("safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_'@all) AS name FROM {pages}")
both(
    "corpus_parts",
    "SELECT doc_id, i AS chunk_index, n AS chunk_count, concat('part ', i + 1, '/', n) AS label, md5(substring(text, CAST(i * 2000 + 1 AS INT), 2000)) AS h "
    "FROM (SELECT doc_id, text, n, @each(@seq(0, n - 1)) AS i FROM (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / 2000e0)) AS INT) AS n FROM {documents} WHERE text IS NOT NULL) a) b",
)
both("gold_letter", "SELECT doc_id, chr(CAST(65 + quality + 2 * toxic AS INT)) AS gold FROM {labels}")
both("vote_replication", "SELECT item_id, @each(@seq(1, 256)) AS sample FROM {benchmark}")
both(
    "benchmark_gold_index",
    "SELECT k, CASE kind WHEN 'letter' THEN ascii(v) - 65 WHEN 'label' THEN CAST(v AS INT) WHEN 'answer' THEN CAST(v AS INT) - 1 ELSE CASE WHEN v = 'true' THEN 0 ELSE 1 END END AS gold "
    "FROM (VALUES (1, 'letter', 'C'), (2, 'label', '3'), (3, 'answer', '2'), (4, 'bool', 'true'), (5, 'bool', 'false')) AS t(k, kind, v)",
)
both(
    "prefix_labels",
    "SELECT doc_id, pos, 100 + pos AS input, CASE WHEN pos + 1 < i THEN -100 ELSE 101 + pos END AS label "
    "FROM (SELECT doc_id, i, @each(@seq(0, i + r - 2)) AS pos FROM (SELECT doc_id, 3 + quality AS i, 2 + toxic AS r FROM {labels}) a) b",
)
both(
    "middle_truncation",
    "SELECT k, id FROM (SELECT k, n, b, least(h, CAST(floor(b / 2e0) AS INT)) AS head, @each(@seq(1, n)) AS id FROM (VALUES (1, 10, 5, 2), (2, 10, 5, 512), (3, 4, 9, 2), (4, 4, 0, 2)) AS t(k, n, b, h)) x WHERE b > 0 AND (n <= b OR id <= head OR id > n - (b - head))",
)

# predicates and labels
both("self_contained_snippet", "SELECT doc_id FROM {documents} WHERE length(replace(text, '(', '')) = length(replace(text, ')', '')) AND (length(text) - length(replace(text, '\"', ''))) % 2 = 0")
both("good_statement", "SELECT doc_id, s FROM (SELECT doc_id, split_part(text, chr(10), 1) AS s FROM {documents}) t WHERE length(s) BETWEEN 45 AND 230 AND right(s, 1) = '.'")
both("useful_lines", "SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, @each(@split(text, chr(10))) AS line FROM {documents}) t WHERE trim(line) <> '' AND NOT @like(line, '^ *(- *)?[0-9]+( *-)? *$') GROUP BY doc_id")
both("redirect_page", "SELECT k, lower(substring(ltrim(x), 1, 9)) = '#redirect' AS redirect FROM (VALUES (1, '#REDIRECT [[X]]'), (2, '  #redirect [[Y]]'), (3, 'see #redirect')) AS t(k, x)")
both("parse_quality", "SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 80 THEN 'partial' ELSE 'complete' END AS quality FROM {conversations}")
both("subject_by_keyword", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'rights' WHEN @like(lower(text), 'password|secret|token') THEN 'security' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'general' END AS subject FROM {documents}".replace("'@'", "chr(64)"))
both("verified_label", "SELECT doc_id, CASE WHEN quality + toxic >= 2 OR quality = 1 THEN 'verified' ELSE 'needs-fix' END AS label FROM {labels}")
both("tag_strip", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' '@all)) AS h FROM {pages}")

# generators
both("statement_combinations", "SELECT m, concat(CASE WHEN (m & 1) > 0 THEN 'A' ELSE '' END, CASE WHEN (m & 2) > 0 THEN 'B' ELSE '' END, CASE WHEN (m & 4) > 0 THEN 'C' ELSE '' END, CASE WHEN (m & 8) > 0 THEN 'D' ELSE '' END) AS letters FROM (SELECT @each(@seq(1, 15)) AS m) t")
both("answer_slot", "SELECT doc_id, (instr('0123456789abcdef', substring(md5(concat('slot|', doc_id)), 1, 1)) - 1) % 5 AS slot FROM {labels}")
_NUMBER = "regexp_extract(text, '[0-9][0-9]?[0-9]?[0-9]?', 0)"
both(
    "distorted_statement",
    "SELECT item_id, CASE WHEN n <> '' THEN concat(substring(text, 1, CAST(instr(text, n) AS INT) - 1), CAST(n AS INT) + 1, substring(text, CAST(instr(text, n) + length(n) AS INT), 1000000)) "
    f"WHEN contains(text, ' the ') THEN concat(substring(text, 1, CAST(instr(text, ' the ') AS INT) - 1), ' no ', substring(text, CAST(instr(text, ' the ') + 5 AS INT), 1000000)) END AS body FROM (SELECT item_id, text, {_NUMBER} AS n FROM {{benchmark}}) t",
)

# text rules on literal rows
both("template_strip", "SELECT k, regexp_replace(regexp_replace(regexp_replace(x, '[{][{][^{}]*[}][}]', ''@all), '[{][{][^{}]*[}][}]', ''@all), '[{][{][^{}]*[}][}]', ''@all) AS y FROM (VALUES (1, 'a{' || '{x{' || '{y' || '}' || '}z}' || '}b'), (2, 'plain')) AS t(k, x)")
both("front_value", "SELECT k, regexp_extract(x, '(?m)^title: *(.+)$', 1) AS title FROM (SELECT 1 AS k, concat('---', chr(10), 'title: A law', chr(10), 'date: 20240101', chr(10), '---') AS x UNION ALL SELECT 2, 'none') t")
both("round_and_year", "SELECT k, rnd, coalesce(CAST(nullif(regexp_extract(x, '(20[0-9][0-9])', 1), '') AS INT), 2011 + rnd) AS year FROM (SELECT k, x, CAST(nullif(regexp_extract(x, 'round ([0-9]+)', 1), '') AS INT) AS rnd FROM (VALUES (1, 'round 3 public'), (2, '2019 round 8'), (3, 'no number')) AS t(k, x)) a")
_EIGHT = "[0-9]" * 8
plan(
    "effective_date",
    f"SELECT k, CAST(d AS STRING) AS d, coalesce(d <= DATE '2024-06-01', false) AS effective FROM (SELECT k, CASE WHEN regexp_like(x, '^{_EIGHT}$') THEN CAST(try_to_timestamp(x, 'yyyyMMdd') AS DATE) END AS d FROM (VALUES (1, '20240131'), (2, '20240230'), (3, '2024-1-1'), (4, '20250101')) AS t(k, x)) a",
    f"SELECT k, CAST(d AS STRING) AS d, coalesce(d <= DATE '2024-06-01', false) AS effective FROM (SELECT k, CASE WHEN regexp_matches(x, '^{_EIGHT}$') THEN CAST(try_strptime(x, '%Y%m%d') AS DATE) END AS d FROM (VALUES (1, '20240131'), (2, '20240230'), (3, '2024-1-1'), (4, '20250101')) AS t(k, x)) a",
)
_BOXED = "regexp_extract_all(x, 'boxed[{]((?:[^{}]|[{][^{}]*[}])*)[}]', 1)"
_BOXES = "FROM (SELECT 1 AS k, concat('boxed{a{b', '}c}') AS x UNION ALL SELECT 2, concat('boxed{1', '} and boxed{2', '}') UNION ALL SELECT 3, 'boxed{open') t"
plan("last_boxed", f"SELECT k, try_element_at({_BOXED}, -1) AS y {_BOXES}", f"SELECT k, {_BOXED}[-1] AS y {_BOXES}")
_CALLS = "FROM (SELECT 1 AS k, '[{\"function\":{\"name\":\"ls\",\"arguments\":\"x\"}}]' AS x UNION ALL SELECT 2, 'not json' UNION ALL SELECT 3, '[]') t"
plan(
    "tool_call_name",
    f"SELECT k, coalesce(get_json_object(x, '$[0].function.name'), CASE WHEN x = '[]' THEN '' ELSE x END) AS call {_CALLS}",
    f"SELECT k, coalesce(CASE WHEN json_valid(x) THEN json_extract_string(x, '$[0].function.name') END, CASE WHEN x = '[]' THEN '' ELSE x END) AS call {_CALLS}",
)
_PATHS = "FROM (VALUES (1, 'law book/3'), (2, '민법')) AS t(k, x)"
plan("url_quote", f"SELECT k, replace(replace(replace(url_encode(x), '+', '%20'), '*', '%2A'), '%7E', '~') AS url {_PATHS}", f"SELECT k, url_encode(x) AS url {_PATHS}")
