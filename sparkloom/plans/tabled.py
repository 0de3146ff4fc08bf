"""Rules that are written over a few model rows, applied to all documents.

A model row has a number k and shows one form that a text may have. Every document takes the form that
its id gives it, with its own text in it where the form is a text, so that the rule runs over the whole
table and all of each text. The model rows alone stay in MODELS, for tests worked out by hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import frames, records, rules  # noqa: F401
from sparkloom.plans.dialects import spell
from sparkloom.plans.sqlplans import TEXTS
from sparkloom.registry import ORACLES, QUERIES, load

MODELS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# how a document's text goes into a form: behind it, behind it on a line of its own, or before it
_WAYS = {"tail": "concat(t.{0}, ' ', d.text) AS {0}", "line": "concat(t.{0}, chr(10), d.text) AS {0}", "head": "concat(d.text, ' ', t.{0}) AS {0}"}

_FORMS = re.compile(r"\(VALUES (?P<a>.+?)\) AS t\((?P<ac>[^)]*)\)|VALUES (?P<b>.+?) AS t\((?P<bc>[^)]*)\)|\((?P<c>SELECT 1 AS k, .+?)\) t(?![a-z.(])", re.S)


def _over_documents(sql: str, forms: int, ways: dict[str, str], only: int | None) -> str:
    seen = -1

    def put(m: re.Match[str]) -> str:
        nonlocal seen
        seen += 1
        if only is not None and seen != only:
            return m[0]
        names = (m["ac"] or m["bc"] or "k, " + ", ".join(x for x in re.findall(r" AS (\w+)", re.split(" UNION ALL ", m["c"])[0])[1:])).split(", ")
        given = f"({m['c']}) AS t" if m["c"] else f"(VALUES {m['a'] or m['b']}) AS t({', '.join(names)})"
        own = [_WAYS[ways[n]].format(n) if n in ways else f"t.{n}" for n in names[1:]]
        return f"(SELECT d.doc_id * 16 + t.k AS k, {', '.join(own)} FROM \x04documents\x05 d JOIN {given} ON t.k = 1 + d.doc_id % {forms}) AS t"

    out, n = _FORMS.subn(put, sql)
    if not n:
        raise ValueError(f"no model rows in {sql}")
    return out


def tabled(name: str, forms: int, only: int | None = None, **ways: str) -> None:
    """Run a registered rule over all documents; ``ways`` says which columns take in the text, ``only`` which of several relations."""
    _register(name, *(_over_documents(text, forms, ways, only) for text in TEXTS[name]))


def _register(name: str, spark_text: str, duck_text: str) -> None:
    """Texts name documents between two marks, as braces in literals are the rule's own."""
    told = spark_text.replace("{", "{{").replace("}", "}}").replace("\x04", "{").replace("\x05", "}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(told, documents=load(spark, sf_dir, "documents"))

    MODELS[name] = QUERIES[name]
    QUERIES[name] = run
    ORACLES[name] = duck_text.replace("\x04", "").replace("\x05", "")


def written(name: str, sql: str) -> None:
    """Run a registered rule over all documents by a text of its own."""
    text = sql.replace("{documents}", "\x04documents\x05")
    _register(name, spell(text, 0), spell(text, 1))


for _name, _n in {"benchmark_gold_index": 5, "condition_normalize": 3, "effective_date": 4, "mcq_bracket_options": 3, "middle_truncation": 4, "norm_gold": 12, "render_structured": 2, "role_variants": 6, "tool_call_name": 3, "valid_answer_code": 7, "mcq_render": 2, "last_boxed": 3, "numeric_truth": 2}.items():
    tabled(_name, _n, **({"x": "head"} if _name in ("last_boxed", "numeric_truth") else {}))
for _name, _n in {"article_heading": 4, "article_references": 4, "clause_snippets": 2, "last_option_letter": 2, "parse_answer": 3, "redirect_page": 3, "round_and_year": 3, "split_prompt": 3, "template_strip": 2, "think_strip": 3, "url_quote": 2}.items():
    tabled(_name, _n, x="tail")
for _name, _n in {"choice_parser": 2, "content_flatten": 2, "front_matter": 2, "front_value": 2, "merge_lines": 2, "section_upsert": 3, "statement_splitter": 2, "statute_context": 2, "wikitext_clean": 2}.items():
    tabled(_name, _n, x="line")
tabled("sql_table_names", 2, q="tail")
tabled("schema_slimming", 3, q="tail")
tabled("schema_blocks", 3, q="tail")
tabled("labelled_qa_rows", 4, q="tail", a="tail")
tabled("benchmark_rows", 5, q="tail")
tabled("tool_call_render", 4, content="tail")
tabled("excerpt_budget", 2, body="tail")
tabled("best_blocks", 2, body="tail")
tabled("drop_em_f1", 3)
tabled("mcq_kshot", 3, only=1, q="tail")
written("lr_schedule", "SELECT s, round(CASE WHEN s < 10 THEN s / 10e0 ELSE 1e-1 + 45e-2 * (1 + cos(pi() * (s - 10) / 90e0)) END, 9) AS lr FROM (SELECT doc_id % 101 AS s FROM {documents}) t")
written("resume_step_offset", "SELECT stage, steps, CAST(sum(steps) OVER (ORDER BY stage NULLS FIRST ROWS UNBOUNDED PRECEDING) - steps AS BIGINT) AS first_step FROM (SELECT source AS stage, count(*) AS steps FROM {documents} GROUP BY source) t")
written("statement_combinations", "SELECT doc_id, m, concat(CASE WHEN m % 2 > 0 THEN 'A' ELSE '' END, CASE WHEN m % 4 > 1 THEN 'B' ELSE '' END, CASE WHEN m % 8 > 3 THEN 'C' ELSE '' END, CASE WHEN m > 7 THEN 'D' ELSE '' END) AS letters FROM (SELECT doc_id, 1 + doc_id % 15 AS m FROM {documents}) t")
written("circled_digits", "SELECT doc_id, md5(regexp_replace(translate(x, '①②③④⑤', '12345'), '[ \t\n]+', ''@all)) AS y FROM (SELECT doc_id, concat(CASE doc_id % 2 WHEN 0 THEN '①' ELSE '③, ⑤' END, text) AS x FROM {documents}) t")
written(
    "text2sql_normalize",
    "SELECT sha1(concat(s, chr(10), q, chr(10), a)) AS fingerprint, concat_ws(chr(10), concat('Dialect: ', d), concat('Schema:', chr(10), s), concat('Question: ', q), 'SQL:') AS instruction, a AS response "
    "FROM (SELECT concat('CREATE TABLE t', doc_id, ' (a INT)') AS s, text AS q, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE concat('SELECT count(*) FROM t', doc_id) END AS a, lang AS d FROM {documents}) t WHERE trim(q) <> '' AND trim(a) <> ''",
)
written(
    "attachment_inclusion",
    "SELECT article_id, filename FROM (SELECT doc_id AS article_id, CASE WHEN doc_id % 5 < 2 OR doc_id % 5 = 4 THEN 'exam' ELSE 'answer' END AS kind, "
    "concat(source, CASE doc_id % 5 WHEN 0 THEN ' choice.hwp' WHEN 1 THEN ' essay.hwp' WHEN 2 THEN ' final.pdf' WHEN 3 THEN ' draft.zip' ELSE ' notes.txt' END) AS filename FROM {documents}) t "
    "WHERE (kind = 'answer' AND NOT @like(filename, 'zip$')) OR (kind = 'exam' AND contains(filename, 'choice')) OR article_id = 99",
)
