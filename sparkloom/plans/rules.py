"""Filters, record builders, lookups and text rules over tables or literal rows."""

from __future__ import annotations

from sparkloom.plans.dialects import both, spell
from sparkloom.plans.sqlplans import plan


def rows(columns: str, *values: str) -> str:
    """Literal rows as a relation."""
    return f"(VALUES {', '.join(values)}) AS t({columns})"


# filters
both("response_max_filter", "SELECT conv_id, turn FROM {conversations} WHERE role = 'assistant' AND length(text) <= 200")
both(
    "valid_answer_code",
    "SELECT k FROM " + rows("k, rnd, code", "(1, 3, '4')", "(2, 3, '70')", "(3, 3, '1,2')", "(4, 3, 'none')", "(5, 99, '2')", "(6, 9, '6')", "(7, 1, '5')")
    + " WHERE rnd BETWEEN 1 AND 14 AND @like(code, '^([1-5]|[1-7]0)$')",
)
both(
    "gold_null_excluded",
    "SELECT count(*) AS total, count(gold) AS judged, CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (SELECT CASE WHEN @like(raw, '^[1-9]0?$') THEN CAST(substring(raw, 1, 1) AS INT) END AS gold, pred FROM "
    "(SELECT CASE WHEN doc_id % 11 = 0 THEN '1,2' WHEN doc_id % 7 = 0 THEN concat(quality + 1, '0') ELSE CAST(quality + 1 AS STRING) END AS raw, toxic + 1 AS pred FROM {labels}) a) b",
)
# answers one to nine, or one to five as they stand; a composite code such as 30 counts as its first digit
both(
    "norm_gold",
    r"SELECT k, CASE WHEN @like(a, '^0*[1-9]$') THEN right(a, 1) WHEN @like(a, '^[1-9]0$') THEN left(a, 1) END AS gold, "
    r"CASE WHEN @like(a, '^0*[1-5]$') THEN a WHEN @like(a, '^[1-5]0$') THEN left(a, 1) END AS gold_of_five "
    r"FROM (SELECT k, regexp_replace(coalesce(x, ''), @r'^\s+|\s+$', ''@all) AS a FROM "
    + rows("k, x", "(1, '30')", "(2, '1,2')", "(3, '')", "(4, '7')", "(5, ' 4 ')", "(6, concat('70', chr(10)))", "(7, NULL)", "(8, '03')", "(9, '10')", "(10, '0')", "(11, '33')", "(12, 'none')")
    + ") t",
)
both("retrieval_noise_filter", "SELECT doc_id, item_id FROM (SELECT d.doc_id, b.item_id, d.text FROM {documents} d JOIN {benchmark} b ON d.doc_id = b.item_id) j WHERE NOT @like(lower(text), 'official answer|answer key') AND length(text) >= 3 AND NOT contains(text, concat('case ', item_id))")
both(
    "attachment_inclusion",
    "SELECT article_id, filename FROM "
    + rows("kind, article_id, filename", "('exam', 10, 'round1 choice.hwp')", "('exam', 11, 'essay.hwp')", "('answer', 12, 'final.pdf')", "('answer', 13, 'draft.zip')", "('exam', 99, 'notes.txt')")
    + " WHERE (kind = 'answer' AND NOT @like(filename, 'zip$')) OR (kind = 'exam' AND contains(filename, 'choice')) OR article_id = 99",
)
both("null_as_zero_sort", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0), event_id) AS place FROM {events}")

# record builders
_PROMPTS = rows("k, x", "(1, concat('Schema:', chr(10), 'CREATE TABLE a (b INT)', chr(10), 'Question: how many?'))", "(2, concat('### Instruction: list all', chr(10), '### Input: CREATE TABLE c (d INT)', chr(10), '### Response:'))", "(3, 'no marker')")
both(
    "split_prompt",
    "SELECT k, replace(CASE WHEN contains(x, '### Input:') THEN split_part(split_part(x, '### Input: ', 2), '### Response:', 1) WHEN contains(x, 'Question:') THEN split_part(split_part(x, 'Question:', 1), 'Schema:', 2) ELSE '' END, chr(10), '') AS db, "
    f"replace(CASE WHEN contains(x, '### Input:') THEN split_part(split_part(x, '### Instruction: ', 2), '### Input:', 1) WHEN contains(x, 'Question:') THEN split_part(x, 'Question: ', 2) ELSE x END, chr(10), '') AS question FROM {_PROMPTS}",
)
both(
    "flatten_to_pair",  # system and user turns instruct, the last assistant turn responds
    "SELECT conv_id, md5(@cat(CASE WHEN role <> 'assistant' THEN text END, concat(chr(10), chr(10)) @by CASE WHEN role = 'system' THEN -1 ELSE turn END)) AS instruction_md5, "
    "substring(max(CASE WHEN role = 'assistant' THEN concat(lpad(CAST(turn AS STRING), 9, '0'), text) END), 10, 1000000) AS response FROM {conversations} GROUP BY conv_id",
)
both("retemplate_prompt", "SELECT conv_id, turn, concat('[Task]', chr(10), regexp_replace(text, '^[^:.]*: *', ''), chr(10), 'Answer:') AS prompt FROM {conversations} WHERE role = 'user' AND text IS NOT NULL")
both("exam_templates", "SELECT doc_id, concat('Question ', doc_id, chr(10), 'Choose one of 1 to 5.') AS instruction, concat('Answer: ', quality + 2 * toxic + 1) AS response FROM {labels}")
both(
    "message_rows",  # messages as JSON, the answer's letter and text, and a fingerprint
    "SELECT item_id, concat('[', chr(123), '\"role\":\"user\",\"content\":\"item ', item_id, '\"', chr(125), ',', chr(123), '\"role\":\"assistant\",\"content\":\"', item_id % 5 + 1, '\"', chr(125), ']') AS messages, "
    "chr(CAST(65 + item_id % 5 AS INT)) AS letter, substring(@sha(concat(item_id, chr(10), text)@end256, 1, 16) AS fingerprint, length(text) AS n FROM {benchmark}",
)
_CHOICES = rows("k, shot, q, a", "(1, 1, 'one?', @arr('red', 'blue'))", "(2, 1, 'two?', @arr('up', 'down', 'left'))", "(3, 0, 'three?', @arr('x', 'y'))")
_BODY = "concat(q, chr(10), @join(@map(a, @xi concat({0}, x)), chr(10)))"
both(
    "mcq_kshot",
    f"SELECT k, (SELECT @cat(concat({_BODY.format('chr(CAST(65 + @i AS INT)), chr(46), chr(32)')}, chr(10), 'Answer: A'), concat(chr(10), chr(10)) @by k) FROM {_CHOICES} WHERE shot = 1) || chr(10) || chr(10) || {_BODY.format('chr(CAST(65 + @i AS INT)), chr(46), chr(32)')} AS prompt FROM {_CHOICES} WHERE shot = 0",
)
both("mcq_bracket_options", f"SELECT k, @join(@map(a, @xi concat('(', chr(CAST(65 + @i AS INT)), ') ', x)), chr(10)) AS options FROM {_CHOICES}")
both("prompt_template", "SELECT item_id, replace('Q: <prompt> Think.', '<prompt>', text) AS prompt FROM {benchmark}")
_MAPS = rows("k, names, vals", "(1, @arr('A', 'B'), @arr('first', 'second'))", "(2, @arr('x'), @arr('only'))")
plan(
    "render_structured",
    spell(f"SELECT k, array_join(zip_with(names, vals, (n, v) -> concat(n, ': ', v)), '\\n') AS body FROM {_MAPS}", 0),
    spell(f"SELECT k, array_to_string(list_transform(list_zip(names, vals), lambda z: z[1] || ': ' || z[2]), chr(10)) AS body FROM {_MAPS}", 1),
)
both(
    "rag_messages",  # a system turn, shots of the subject, context if there is any, and the question
    "SELECT d.doc_id, concat('[system]', chr(10), 'Answer with one number.', chr(10), CASE WHEN b.text IS NULL THEN '' ELSE concat('[context]', chr(10), substring(b.text, 1, 80), chr(10)) END, '[user]', chr(10), substring(d.text, 1, 60)) AS body FROM {documents} d LEFT JOIN {benchmark} b ON b.item_id = d.doc_id",
)
both("rag_context_attach", "SELECT l.doc_id, l.quality, b.text IS NOT NULL AS has_context FROM {labels} l LEFT JOIN {benchmark} b ON b.item_id = l.doc_id")
both(
    "section_tasks",  # a JSON row and a summary row of each document with sections, at most eight section rows
    "SELECT doc_id, line, kind FROM (SELECT doc_id, line, CASE WHEN line = 0 THEN 'title' ELSE 'section' END AS kind, length(body) AS n FROM "
    "(SELECT doc_id, i AS line, @at(s, CAST(i + 1 AS INT)) AS body FROM (SELECT doc_id, s, @each(@seq(0, least(@len(s) - 1, 8))) AS i FROM (SELECT doc_id, @split(text, chr(10)) AS s FROM {documents}) a) b) c) d WHERE n >= 80 "
    "UNION ALL SELECT doc_id, -1, 'summary' FROM {documents} WHERE length(text) >= 300",
)
both(
    "benchmark_rows",  # query, choices and gold index of four layouts
    "SELECT k, kind, q, CASE kind WHEN 'arc' THEN ascii(v) - 65 WHEN 'hellaswag' THEN CAST(v AS INT) WHEN 'winogrande' THEN CAST(v AS INT) - 1 ELSE CASE WHEN v = 'true' THEN 0 ELSE 1 END END AS gold, "
    "CASE kind WHEN 'boolq' THEN 'Yes|No' ELSE concat(c1, '|', c2) END AS choices FROM "
    + rows("k, kind, q, v, c1, c2", "(1, 'arc', 'Why?', 'B', 'x', 'y')", "(2, 'hellaswag', 'He', '0', 'runs', 'sits')", "(3, 'winogrande', 'The _ fell', '2', 'cup', 'mat')", "(4, 'boolq', 'Is it?', 'true', '', '')", "(5, 'boolq', 'Was it?', 'false', '', '')"),
)
both("conversation_metadata", "SELECT conv_id, turn, concat('Category: chat', chr(10), 'Model: m', conv_id % 3, chr(10), chr(10), substring(text, 1, 100)) AS instruction, 'cot' AS condition FROM {conversations} WHERE role = 'user' AND text IS NOT NULL")
both("labelled_qa_rows", "SELECT k, concat_ws(chr(10), CASE WHEN topic <> '' THEN concat('Topic: ', topic) END, concat('Question: ', q)) AS instruction, a AS response FROM " + rows("k, topic, q, a", "(1, 'sums', '1+1?', '2')", "(2, '', 'why?', 'so')", "(3, 'x', '', 'y')", "(4, 'x', 'y?', ' ')") + " WHERE trim(q) <> '' AND trim(a) <> ''")
both("condition_tokens", "SELECT conv_id, turn, concat('<boq>', CASE WHEN contains(text, '?') THEN '<cot>' ELSE '<direct>' END, text, '<eoq>') AS prompt FROM {conversations} WHERE role = 'user'")
both("history_bar_format", "SELECT conv_id, @cat(concat('<|', role, '|>', chr(10), text), chr(10) @by turn) AS body FROM {conversations} WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id")
both("role_variants", "SELECT k, CASE lower(r) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'function' THEN 'tool' ELSE lower(r) END AS a, CASE lower(r) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'user' ELSE 'assistant' END AS b, CASE lower(r) WHEN 'toolresult' THEN 'tool' WHEN '' THEN 'user' ELSE lower(r) END AS c FROM " + rows("k, r", "(1, 'Human')", "(2, 'GPT')", "(3, 'tool')", "(4, 'toolResult')", "(5, '')", "(6, 'system')"))

# joins and lookups
both("document_attachments", "SELECT d.doc_id, p.page_id, p.url FROM {documents} d JOIN {pages} p ON p.page_id = d.doc_id")
both("global_shots", "SELECT item_id, concat(s.shots, chr(10), substring(text, 1, 40)) AS prompt FROM {benchmark} CROSS JOIN (SELECT @cat(line, chr(10) @by doc_id) AS shots FROM (SELECT doc_id, substring(text, 1, 20) AS line FROM {documents} WHERE text IS NOT NULL ORDER BY doc_id LIMIT 3) a) s")
both(
    "generations_by_range",  # flattened generations go back to their benchmark by [start, end)
    "SELECT g.event_id, b.name, g.event_id - b.first AS idx FROM {events} g JOIN (SELECT name, CAST(sum(n) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last FROM (VALUES ('arc', 400), ('boolq', 250), ('drop', 350)) AS t(name, n)) b ON g.event_id >= b.first AND g.event_id < b.last",
)
_TABLES = rows(
    "k, ddl, q, most",
    "(1, 'CREATE TABLE a (x INT); CREATE TABLE b (y INT); CREATE TABLE c (z INT);', 'select * from db.b join c on 1', 60)",
    "(2, 'CREATE TABLE a (x INT);', 'select 1', 600)",
    "(3, 'CREATE TABLE a (x INT); CREATE TABLE bb (y INT); create table c (z INT);', 'select * from nothing', 30)",
)
_BLOCKS = "@keep(@map(@split(regexp_replace(ddl, '(?i)(create +table +)', concat(chr(1), {0})@all), chr(1)), @x trim(regexp_replace(trim(x), '[; ]+$', ''))), @x x <> '')"
_USED = "@map(regexp_extract_all(lower(q), '(?:from|join) +([a-z_.]+)', 1), @x regexp_extract(x, '([a-z_]+)$', 1))"
_NAME = "regexp_extract(lower({0}), 'create +table +([a-z_]+)', 1)"


def _slim(k: int) -> str:
    blocks = f"SELECT k, most, ddl, {_USED} AS used, {_BLOCKS.format('@g1')} AS blocks FROM {_TABLES}"
    lines = f"SELECT k, most, length(ddl) AS n, used, i, @at(blocks, CAST(i AS INT)) AS body FROM (SELECT *, @each(@seq(1, @len(blocks))) AS i FROM ({blocks}) b) c"
    ranked = f"SELECT *, CASE WHEN @has(used, {_NAME.format('body')}) THEN 0 ELSE 1 END AS late FROM ({lines}) d"
    summed = f"SELECT *, sum(length(body) + 3) OVER (PARTITION BY k ORDER BY late, i ROWS UNBOUNDED PRECEDING) - 2 AS ends FROM ({ranked}) e"
    return spell(f"SELECT k, @cat(concat(body, ';'), concat(chr(10), chr(10)) @by late, i) AS slim, max(n) > max(most) AS slimmed FROM ({summed}) f WHERE n <= most OR late = 0 OR ends <= most GROUP BY k", k)


plan("schema_slimming", _slim(0), _slim(1))
both("schema_blocks", f"SELECT k, @len(blocks) AS n, @join(blocks, '|') AS body FROM (SELECT k, {_BLOCKS.format('@g1')} AS blocks FROM {_TABLES}) b")

# aggregates
both("numeric_accuracy", "SELECT count(*) AS n, round(avg(CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(avg(CASE WHEN pred IS NULL THEN 1e0 ELSE 0e0 END), 9) AS invalid FROM (SELECT event_id % 7 AS truth, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 5 END AS pred FROM {events}) t")
both(
    "drop_em_f1",  # exact match and token F1 of a prediction against its gold text
    "SELECT round(avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END), 9) AS em, round(avg(f1), 9) AS f1 FROM (SELECT p.k, max(p.x) AS pred, max(p.y) AS gold, coalesce(2e0 * max(m.hit) / (max(@len(@split(p.x, ' '))) + max(@len(@split(p.y, ' ')))), 0e0) AS f1 "
    "FROM {pairs} p LEFT JOIN (SELECT a.k, count(*) AS hit FROM (SELECT k, @each(@split(x, ' ')) AS w FROM {pairs}) a JOIN (SELECT k, @each(@split(y, ' ')) AS w FROM {pairs}) b ON a.k = b.k AND a.w = b.w GROUP BY a.k) m ON m.k = p.k GROUP BY p.k) t".replace(
        "{pairs}", "(SELECT * FROM " + rows("k, x, y", "(1, 'red car', 'red car')", "(2, 'blue car', 'red car')", "(3, 'sun', 'moon')") + ")"
    ),
)
both("length_comparison", "SELECT source, round(avg(n_chars), 6) AS mean, round(@pct(n_chars, 0.5), 6) AS median, round(@pct(n_chars, 0.75), 6) AS p75, round(@pct(n_chars, 0.9), 6) AS p90, round(avg(CASE WHEN contains(lower(text), 'license') THEN 100e0 ELSE 0e0 END), 6) AS flagged FROM {documents} GROUP BY source")
both("qa_issues", "SELECT o_orderstatus, n_name, count(*) AS found FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey GROUP BY o_orderstatus, n_name HAVING count(*) NOT IN (0, 40)")
both("vote_distribution", "SELECT l_orderkey, @cat(concat(vote, ':', n), ' ' @by n DESC, vote) AS votes FROM (SELECT l_orderkey, CAST(l_quantity % 5 AS INT) AS vote, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, CAST(l_quantity % 5 AS INT)) c GROUP BY l_orderkey")

# text rules
both("sentence_split", "SELECT item_id, i - 1 AS place, @at(s, CAST(i AS INT)) AS sentence FROM (SELECT item_id, s, @each(@seq(1, @len(s))) AS i FROM (SELECT item_id, @keep(@split(regexp_replace(replace(text, chr(10), ' '), '([.]) +', concat(@g1, chr(1))@all), chr(1)), @x trim(x) <> '') AS s FROM {benchmark}) a) b")
_ARTICLES = rows("k, x", "(1, '제12조의3(정의) 이 법에서')", "(2, '제5조 삭제')", "(3, 'none')", "(4, '제7조(목적) 제12조의3 및 제7조에 따라')")
both("article_heading", f"SELECT k, regexp_extract(x, '^(제[0-9]+조(의[0-9]+)?)', 1) AS article, regexp_extract(x, '^제[0-9]+조(?:의[0-9]+)?[(]([^)]*)[)]', 1) AS title FROM {_ARTICLES}")
_REFS = "regexp_extract_all(x, '제[0-9]+조(?:의[0-9]+)?', 0)"
plan(
    "article_references",
    f"SELECT k, array_join(slice(array_distinct({_REFS}), 1, 8), ' ') AS refs FROM {_ARTICLES}",
    f"SELECT k, array_to_string(list_slice(list_filter({_REFS}, lambda y, i: list_position({_REFS}, y) = i), 1, 8), ' ') AS refs FROM {_ARTICLES}",
)
plan(
    "ordered_distinct",
    "SELECT doc_id, array_join(slice(array_distinct(split(text, '[ \\n]+')), 1, 10), ' ') AS words FROM {documents}",
    "SELECT doc_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 10), ' ') AS words FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents) t",
)
_CLAUSES = rows("k, x", "(1, '① 국가는 모든 국민의 권리를 보장하여야 하며 이를 침해할 수 없다. 다만 그러하지 아니하다. ② 삭제 ③ 지방자치단체는 주민의 복리에 관한 사무를 처리하고 재산을 관리한다.')", "(2, '짧다')")
both(
    "clause_snippets",  # the first sentence of each circled clause, of 28 to 240 characters, without a deletion mark
    "SELECT k, @join(@head(@keep(@map(@split(regexp_replace(x, '([①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮])', concat(chr(1), @g1)@all), chr(1)), @x regexp_replace(regexp_extract(trim(x), '^([^.]*[.]?)', 1), '^[①-⑳] *', '')), @x length(x) BETWEEN 28 AND 240 AND NOT contains(x, '삭제')), 1, 6), '|') AS snippets "
    f"FROM {_CLAUSES}",
)
_MERGE = "regexp_replace(regexp_replace(regexp_replace({0}, '\n([·,.;:)\\]〉」』])', @g1@all), '([｢「『(〈\\[])\n', @g1@all), '\n\n\n+', '\n\n'@all)"
_BLOCK = rows("k, x", "(1, concat('다음 중 옳은 것은', chr(10), '?', chr(10), '① 하나', chr(10), '계속', chr(10), ', 끝', chr(10), '② 둘 ③ 셋', chr(10), '④', chr(10), '넷'))", "(2, concat('보기 ① 은 본문이다', chr(10), chr(10), '끝'))")


def _merged(k: int, x: str) -> str:
    text = spell(_MERGE, k).format(x)
    return text.replace("\\]", "\\\\]").replace("\\[", "\\\\[").replace("\n", "\\n") if k == 0 else text


def _choices(k: int) -> str:
    """Stem and choices of a block: a mark starts a choice where its line starts with a mark."""
    marks = "①②③④⑤"
    lines = spell(f"@keep(@map(@split(x, chr(10)), @x trim(x)), @x x <> '')", k)
    cut = spell(f"@map({lines}, @x CASE WHEN @like(x, '^[{marks}]') THEN regexp_replace(x, '([{marks}])', concat(chr(1), @g1)@all) ELSE x END)", k)
    parts = spell(f"@split(@join({cut}, chr(10)), chr(1))", k)
    stem = _merged(k, spell("trim(@at(p, 1), chr(10))", k) if k else "trim(BOTH chr(10) FROM try_element_at(p, 1))")
    body = f"CAST(@len(p) - 1 AS BIGINT) AS n"
    rest = spell("@map(p, @x trim(replace(x, chr(10), ' ')))", k)
    return spell(f"SELECT k, {stem} AS stem, {body}, @join({rest}, '|') AS parts FROM (SELECT k, {parts} AS p FROM {_BLOCK}) a", k)


plan("choice_parser", _choices(0), _choices(1))
plan("merge_lines", f"SELECT k, {_merged(0, 'x')} AS y FROM {_BLOCK}", f"SELECT k, {_merged(1, 'x')} AS y FROM {_BLOCK}")
_STATEMENTS = rows("k, x", "(1, concat('옳은 것은?', chr(10), 'ㄱ. 첫째 진술은 참이라고 한다', chr(10), 'ㄴ. 둘째 진술은 거짓이라 한다', chr(10), '①', chr(10), 'ㄱ, ㄴ'))", "(2, concat('고르시오', chr(10), '①', chr(10), '하나의 진술이 여기에 있다', chr(10), '②', chr(10), '둘'))")
both(
    "statement_splitter",  # lettered statements up to the bundle of answers, else circled ones; eight characters at least
    "SELECT k, @join(@keep(@map(CASE WHEN @like(x, '\n[ㄱ-ㅎ][.]') THEN @split(regexp_replace(split_part(x, concat(chr(10), '①', chr(10)), 1), '\n([ㄱ-ㅎ])[.] *', concat(chr(1), @g1, '|')@all), chr(1)) "
    "ELSE @split(regexp_replace(x, '\n([①②③④⑤])\n', concat(chr(1), @g1, '|')@all), chr(1)) END, @x replace(x, chr(10), ' ')), @x contains(x, '|') AND length(replace(x, ' ', '')) >= 10), ';') AS statements "
    f"FROM {_STATEMENTS}",
)
_CALLS = rows("k, content, calls", "(1, 'look', '[{\"function\":{\"name\":\"ls\",\"arguments\":\"x\"}}]')", "(2, '', 'not json')", "(3, 'done', '[]')", "(4, 'say', '')")
_NAMED = {0: "get_json_object(calls, '$[0].function.name')", 1: "CASE WHEN json_valid(calls) THEN json_extract_string(calls, '$[0].function.name') END"}
_ARGS = {0: "get_json_object(calls, '$[0].function.arguments')", 1: "CASE WHEN json_valid(calls) THEN json_extract_string(calls, '$[0].function.arguments') END"}


def _rendered(k: int) -> str:
    raw = "concat('<tool_call>', chr(10), CASE WHEN left(calls, 1) = '[' THEN calls ELSE concat('[{\"type\":\"raw\",\"content\":\"', calls, '\"}]') END, chr(10), '</tool_call>')"
    marker = f"CASE WHEN calls IN ('', '[]') THEN NULL ELSE {raw} END"
    action = f"CASE WHEN calls IN ('', '[]') THEN NULL ELSE concat('Action: ', coalesce({_NAMED[k]}, 'raw'), chr(10), 'Action Input: ', coalesce('\"' || {_ARGS[k]} || '\"', concat(chr(123), chr(125)))) END"
    joined = lambda x: f"concat_ws(concat(chr(10), chr(10)), nullif(content, ''), {x})"
    return f"SELECT k, {joined(marker)} AS marker, {joined(action)} AS action FROM {_CALLS}"


plan("tool_call_render", _rendered(0), _rendered(1))
_PARTS = rows("k, kind, x", "(1, 'text', 'hello')", "(1, 'thinking', ' deep ')", "(1, 'tool_use', '{}')", "(2, 'text', ' ')", "(2, 'other', '1')")
_FLAT = f"SELECT k, @cat(CASE kind WHEN 'text' THEN x WHEN 'thinking' THEN concat('<think>', chr(10), trim(x), chr(10), '</think>') WHEN 'tool_use' THEN concat('[tool_call]', chr(10), x) ELSE x END, concat(chr(10), chr(10)) @by kind DESC) AS body FROM {_PARTS} WHERE trim(x) <> '' GROUP BY k"
both("content_flatten", _FLAT)
_FRONT = rows("k, x", "(1, concat('---', chr(10), 'title: A law', chr(10), 'tags:', chr(10), '- one', chr(10), 'date: 20240101', chr(10), '---', chr(10), 'Body here'))", "(2, 'No front')")
both(
    "front_matter",
    "SELECT k, CASE WHEN @len(p) > 2 THEN @join(@keep(@split(@at(p, 2), chr(10)), @x contains(x, ': ') AND NOT @like(x, '^- ')), ';') ELSE '' END AS meta, CASE WHEN @len(p) > 2 THEN trim(replace(@at(p, 3), chr(10), ' ')) ELSE x END AS body "
    f"FROM (SELECT k, x, @split(x, '---') AS p FROM {_FRONT}) a",
)
_CONTEXT = rows("k, x", "(1, concat('## Law', chr(10), '```', chr(10), 'art 1', chr(10), '```', chr(10), 'note', chr(10), '```', chr(10), 'art 2', chr(10), '```', chr(10), '## Next', chr(10), '```', chr(10), 'no', chr(10), '```'))", "(2, 'none')")
both("statute_context", f"SELECT k, substring(@join(regexp_extract_all(split_part(split_part(x, '## Law', 2), '## ', 1), '```\n([^`]*)\n```', 1), concat(chr(10), chr(10))), 1, 3000) AS context FROM {_CONTEXT}")
_EXCERPTS = rows("k, i, body", "(1, 1, repeat('a', 500))", "(1, 2, repeat('b', 600))", "(1, 3, repeat('c', 300))", "(2, 1, repeat('d', 1300))")
both("excerpt_budget", f"SELECT k, i, length(body) AS n FROM (SELECT *, sum(length(body)) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS total FROM {_EXCERPTS}) a WHERE total < 1200")
both("best_blocks", f"SELECT k, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN contains(body, 'c') THEN -2 ELSE -1 END, length(body), i) AS place FROM {_EXCERPTS}) a WHERE place <= 2")
both(
    "advice_rules",  # up to four pieces of advice by rule
    "SELECT doc_id, @join(@head(@keep(@arr(CASE WHEN contains(lower(text), 'license') THEN 'check the licence' ELSE '' END, CASE WHEN @like(text, '[0-9]') THEN 'check numbers' ELSE '' END, CASE WHEN length(text) > 2000 THEN 'split it' ELSE '' END, CASE WHEN contains(text, chr(64)) THEN 'mask addresses' ELSE '' END, CASE WHEN lang <> 'en' THEN 'translate' ELSE '' END), @x x <> ''), 1, 4), '; ') AS advice FROM {documents} WHERE text IS NOT NULL",
)
_WIKI = rows("k, x", "(1, concat(repeat(chr(123), 2), 'Info|a=', repeat(chr(123), 2), 'b', repeat(chr(125), 4), 'Text <!-- note -->with <ref name=x>r</ref>[[File:a.jpg|thumb]] [[Law|laws]] and [[Court]].', chr(10), '== Head ==', chr(10), '* item', chr(10), chr(39), chr(39), 'it', chr(39), chr(39), chr(10), '[[Category:X]]'))", "(2, 'plain')")
_STEPS = [
    ("(?s)<!--.*?-->", "''"), ("(?s)<ref[^>]*>.*?</ref>", "''"), ("[{][{][^{}]*[}][}]", "''"), ("[{][{][^{}]*[}][}]", "''"), ("[{][{][^{}]*[}][}]", "''"),
    ("[[][[](?:File|Category):[^]]*[]][]]", "''"), ("[[][[][^]|]*[|]([^]|]*)[]][]]", "@g1"), ("[[][[]([^]|]*)[]][]]", "@g1"), ("=+ *([^=\n]+?) *=+", "@g1"), ("<[^>]*>", "''"), ("''+", "''"), ("(?m)^[*#:;]+ *", "''"), ("\n\n\n+", "'\n\n'"),
]


def _wiki(k: int) -> str:
    x = "x"
    for pattern, by in _STEPS:
        quoted = pattern.replace("''+", "''''+")
        x = f"regexp_replace({x}, '{quoted}', {by}@all)"
    x = spell(x, k)
    if k == 0:
        x = x.replace("[[]", "\\\\[").replace("[]]", "\\\\]").replace("[^]|]", "[^\\\\]|]").replace("[^]]", "[^\\\\]]").replace("\n", "\\n").replace("''''+", "\\'\\'+")
    return f"SELECT k, trim({x}) AS y FROM {_WIKI}"


plan("wikitext_clean", _wiki(0), _wiki(1))
both("section_upsert", "SELECT k, CASE WHEN contains(x, '## B') THEN regexp_replace(x, '## B\n[^#]*', concat('## B', chr(10), 'new', chr(10))) WHEN contains(x, '## A') THEN concat(x, chr(10), '## B', chr(10), 'new') ELSE concat('## B', chr(10), 'new', chr(10), x) END AS y FROM " + rows("k, x", "(1, concat('## A', chr(10), 'a', chr(10), '## B', chr(10), 'old', chr(10), '## C'))", "(2, concat('## A', chr(10), 'a'))", "(3, 'none')"))
both("markdown_questions", "SELECT item_id, concat('# Item ', item_id, chr(10), chr(10), text, chr(10), chr(10), '- length: ', length(text)) AS body FROM {benchmark}")
both("section_extents", "SELECT doc_id, section, count(*) AS n_lines FROM (SELECT doc_id, line, sum(CASE WHEN length(body) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT doc_id, i AS line, @at(s, CAST(i AS INT)) AS body FROM (SELECT doc_id, s, @each(@seq(1, @len(s))) AS i FROM (SELECT doc_id, @split(text, chr(10)) AS s FROM {documents}) a) b) c) d GROUP BY doc_id, section")
both("term_extraction", "SELECT item_id, @join(@head(@keep(regexp_extract_all(lower(text), '([a-z]+(?:tion|ment|keit|heit))', 1), @x NOT @has(@arr('nation', 'moment'), x)), 1, 12), ' ') AS terms FROM {benchmark}")

# batch forms of watching rules
both("stable_items", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM {events}) t WHERE later IS NULL OR later >= ts + INTERVAL '12' HOUR")
both("grace_restart", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM {events}) a WHERE later > ts + INTERVAL '1' DAY) b WHERE r = 1")
both(
    "attachments_expanded",  # customers with each of their orders as an attachment, those without once
    "SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN NULL ELSE concat('order_', o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '.pdf' ELSE '.hwp' END) END AS filename, "
    "CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS BIGINT) AS number FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey",
)
