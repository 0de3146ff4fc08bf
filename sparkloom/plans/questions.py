"""Question generators: a snippet of a document, partners from the document's group, and a hashed slot.

A document's source is its subject, its language its law, and its first line's first sentence its
snippet. Partners come by place in a hashed ring over the whole group (dialects.ring).
"""

from __future__ import annotations

from sparkloom.plans.dialects import both, ring

_FIRST = "split_part(replace(text, chr(10), ' '), '. ', 1)"
#: doc_id, subject, law, snippet of 28 to 240 characters without a deletion mark, with even quotes and closed brackets.
SNIPPETS = (
    "SELECT doc_id, source AS subject, lang AS law, snippet, regexp_replace(snippet, '[^A-Za-z0-9]+', ''@all) AS norm "
    f"FROM (SELECT doc_id, source, lang, {_FIRST} AS snippet FROM {{documents}} WHERE text IS NOT NULL) s0 "
    "WHERE length(snippet) BETWEEN 28 AND 240 AND NOT contains(snippet, 'deleted') "
    "AND length(replace(snippet, '(', '')) = length(replace(snippet, ')', '')) AND (length(snippet) - length(replace(snippet, '\"', ''))) % 2 = 0"
)
#: One document for each distinct snippet of a subject.
DISTINCT = f"SELECT subject, min(law) AS law, min(snippet) AS snippet, norm, min(doc_id) AS doc_id FROM ({SNIPPETS}) s1 GROUP BY subject, norm"


def slot(seed: str, key: str) -> str:
    """A place from 0 to 4 for the right choice."""
    return f"(instr('0123456789abcdef', substring(md5(concat('{seed}|', {key})), 1, 1)) - 1) % 5"


def choices(pool: str, by: str, seed: str, own: str, other: str, keep: str = "TRUE", shown: str = "''") -> str:
    """doc_id, slot, the five choices and what is ``shown`` of every row of ``pool`` with four partners in its group.

    ``own`` and ``other`` are what a row and its partners (o) put on the list.
    """
    placed = ring(pool, by, "doc_id", seed)
    partners = (
        f"SELECT a.doc_id, a.{by}, a.own, {other} AS body, a.step FROM "
        f"(SELECT *, {own} AS own, @each(@seq(1, 4)) AS step FROM ({placed}) a0) a JOIN ({placed}) o ON o.{by} = a.{by} AND o.pos = (a.pos + a.step) % a.size WHERE o.doc_id <> a.doc_id AND {keep}"
    )
    at = slot(seed, "doc_id")
    # partners before the slot, the own choice, partners after it
    lines = (
        f"SELECT doc_id, {by}, {at} AS slot, CASE WHEN step <= {at} THEN step - 1 ELSE step END AS place, body, '' AS shown FROM ({partners}) c1 "
        f"UNION ALL SELECT doc_id, {by}, {at}, {at}, own, shown FROM (SELECT *, {own} AS own, {shown} AS shown FROM ({placed}) a1) c2"
    )
    return f"SELECT doc_id, {by}, slot, count(*) AS n, max(shown) AS shown, @cat(body, chr(10) @by place) AS choices FROM ({lines}) c3 GROUP BY doc_id, {by}, slot"


def generator(name: str, pool: str, by: str, own: str, other: str, stem: str, shown: str = "''") -> None:
    """A question for every row that has its five choices: stem, choices, answer and fingerprint."""
    both(
        name,
        f"SELECT doc_id, slot + 1 AS answer, {stem} AS stem, md5(choices) AS choices_md5, substring(@sha({stem} || chr(10) || choices@end256, 1, 16) AS fingerprint "
        f"FROM ({choices(pool, by, name, own, other, shown=shown)}) q WHERE n = 5",
    )


_NUMBER = "regexp_extract(snippet, '([0-9]+)', 1)"
# pairs of a phrase and what replaces it, the first that applies is taken
SWAPS = [(" must ", " may "), (" may ", " must "), (" the ", " no "), (" der ", " kein "), (" is ", " is not "), (" le ", " aucun "), (" und ", " oder "), (" and ", " or ")]


def distorted(x: str, number: str) -> str:
    """A false form of a statement of 20 to 260 characters: its first number raised, else a phrase swapped; null if none applies."""
    raised = f"CASE WHEN {number} <> '' AND length({number}) < 9 THEN concat(substring({x}, 1, CAST(instr({x}, {number}) AS INT) - 1), CAST({number} AS INT) + CASE WHEN CAST({number} AS INT) IN (0, 1) THEN 2 ELSE 1 END, substring({x}, CAST(instr({x}, {number}) + length({number}) AS INT), 1000)) END"
    swaps = [f"CASE WHEN contains({x}, '{a}') AND NOT contains({x}, '{b}') THEN concat(substring({x}, 1, CAST(instr({x}, '{a}') AS INT) - 1), '{b}', substring({x}, CAST(instr({x}, '{a}') + {len(a)} AS INT), 1000)) END" for a, b in SWAPS]
    fits = [f"CASE WHEN length({c}) BETWEEN 20 AND 260 THEN {c} END" for c in (raised, *swaps)]
    return f"coalesce({', '.join(fits)})"


_FALSE = f"SELECT *, {distorted('snippet', _NUMBER)} AS wrong FROM ({DISTINCT}) d0"
both("distort_statement", f"SELECT doc_id, snippet, wrong FROM ({_FALSE}) f WHERE wrong IS NOT NULL")

generator("question_article_match", DISTINCT, "subject", "snippet", "o.snippet", "concat('Which is said in document ', doc_id, '?')")
generator("question_negative", f"SELECT * FROM ({_FALSE}) f WHERE wrong IS NOT NULL", "law", "wrong", "o.snippet", "concat('Which is not said in ', law, '?')")
_TERM = "regexp_extract(snippet, '([a-z][a-z][a-z][a-z]+)', 1)"
_TERMS = f"SELECT min(doc_id) AS doc_id, subject, term, min(snippet) AS snippet FROM (SELECT *, {_TERM} AS term FROM ({DISTINCT}) d1) t0 WHERE term <> '' GROUP BY subject, term"
_BLANKED = "concat(substring(snippet, 1, CAST(instr(snippet, term) AS INT) - 1), '[      ]', substring(snippet, CAST(instr(snippet, term) + length(term) AS INT), 1000))"
generator("question_cloze", _TERMS, "subject", "term", "o.term", "concat('What is missing in document ', doc_id, '?', chr(10), shown)", _BLANKED)
generator("question_reference", DISTINCT, "subject", "concat('document ', doc_id)", "concat('document ', o.doc_id)", "concat('Where is the passage of ', doc_id, ' from?')")

# four statements, of which one or two are false; the answer is the set of the true letters among five of the fifteen sets
_LETTERS = "concat(CASE WHEN m % 2 > 0 THEN 'A' ELSE '' END, CASE WHEN m % 4 > 1 THEN 'B' ELSE '' END, CASE WHEN m % 8 > 3 THEN 'C' ELSE '' END, CASE WHEN m > 7 THEN 'D' ELSE '' END)"
_TRUTH = "@at(@arr(3, 5, 6, 9, 10, 12, 7, 11, 13, 14), CAST(1 + (instr('0123456789abcdef', substring(md5(concat('combo|', doc_id)), 1, 1)) + 9) % 10 AS INT))"
_FALSIFIABLE = f"SELECT *, length(subject) % 2 AS kind, 0 AS whole FROM ({_FALSE}) f0 WHERE wrong IS NOT NULL"


def combination(name: str, items: str) -> None:
    """A question for every row of which ``items`` (doc_id, i, label, snippet, wrong) has four: statements with their letters, sets and the right one."""
    told = f"SELECT doc_id, i, {_TRUTH} AS truth, concat(chr(CAST(65 + i AS INT)), '. ', label, CASE WHEN CAST(floor({_TRUTH} / power(2e0, i)) AS INT) % 2 = 1 THEN snippet ELSE wrong END) AS line FROM ({items}) i0"
    asked = f"SELECT doc_id, truth, @cat(line, chr(10) @by i) AS statements, count(*) AS n FROM ({told}) t0 GROUP BY doc_id, truth"
    both(
        name,
        f"SELECT doc_id, truth, md5(statements) AS statements_md5, @cat({_LETTERS}, ' ' @by m) AS options, max(CASE WHEN m = truth THEN {_LETTERS} END) AS answer FROM "
        f"(SELECT doc_id, truth, statements, (truth - 1 + 3 * step) % 15 + 1 AS m FROM (SELECT *, @each(@seq(0, 4)) AS step FROM ({asked}) a0 WHERE n = 4) c1) c2 GROUP BY doc_id, truth, statements",
    )


_OWN_LAW = ring(_FALSIFIABLE, "law", "doc_id", "combination")
_STEPS = "SELECT *, @each(@seq(0, 3)) AS i FROM ({0}) z0"
combination("question_combination", f"SELECT a.doc_id, a.i, '' AS label, o.snippet, o.wrong FROM ({_STEPS.format(_OWN_LAW)}) a JOIN ({_OWN_LAW}) o ON o.law = a.law AND o.pos = (a.pos + a.i) % a.size WHERE a.size > 3")
# two statements of each kind of source: a row's own and the next of its kind, and two of the other kind at its place
_OWN_KIND = ring(_FALSIFIABLE, "kind", "doc_id", "two")
_SIZES = f"SELECT kind AS k, count(*) AS s FROM ({_FALSIFIABLE}) z1 GROUP BY kind"
_MIXED = f"SELECT m.*, n.s FROM (SELECT *, CASE WHEN i < 2 THEN kind ELSE 1 - kind END AS wanted FROM ({_STEPS.format(_OWN_KIND)}) z2) m JOIN ({_SIZES}) n ON n.k = m.wanted WHERE n.s > 1 AND m.size > 1"
combination("question_two_sources", f"SELECT a.doc_id, a.i, concat('[', o.subject, '] ') AS label, o.snippet, o.wrong FROM ({_MIXED}) a JOIN ({_OWN_KIND}) o ON o.kind = a.wanted AND o.pos = (a.pos + a.i % 2) % a.s")
# openings of a case by group of subjects
_INTROS = "(VALUES (0, 'X made a contract with Y on '), (1, 'X was charged over '), (2, 'X contests a notice on ')) AS g(kind, opening)"
both("question_case_intro", f"SELECT q.doc_id, concat(g.opening, q.law, ': ', q.snippet) AS intro FROM (SELECT *, length(subject) % 3 AS kind FROM ({DISTINCT}) d3) q JOIN {_INTROS} ON g.kind = q.kind")
# over-generate, then keep the first of each fingerprint whose snippet no held-out text holds, up to a quota
both(
    "question_accept",
    f"""SELECT doc_id, subject, pos FROM ({ring(f'''SELECT c.* FROM ({DISTINCT}) c LEFT JOIN (SELECT DISTINCT regexp_replace({_FIRST}, '[^A-Za-z0-9]+', ''@all) AS norm FROM {{benchmark}}) b ON b.norm = c.norm WHERE b.norm IS NULL''', 'subject', 'doc_id', 'accept')}) r WHERE pos < 12""",
)
both("snippet_bounds", f"SELECT doc_id, length(snippet) AS n FROM ({SNIPPETS}) s")
both(
    "choices_render_row",  # messages of a question row, as JSON lines have them
    f"SELECT doc_id, concat('[user]', chr(10), 'Which is said in document ', doc_id, '?', chr(10), choices, chr(10), chr(10), '[assistant]', chr(10), slot + 1) AS body FROM ({choices(DISTINCT, 'subject', 'question_article_match', 'snippet', 'o.snippet')}) q WHERE n = 5",
)
