"""Budgets, permutations, quotas and partner draws over whole groups, of which no task holds one."""

from __future__ import annotations

from sparkloom.plans.dialects import both, ranges, ring, running

_BLOCK = ranges("doc_id", "{documents}")
_BYTES = "SELECT doc_id, source, @bytes(coalesce(text, '')) + 1 AS n FROM {documents}"
_WORDS = "SELECT doc_id, source, @len(@split(text, ' ')) AS n FROM {documents}"
_FRAMES = "SELECT doc_id, source, 4 + @len(@split(split_part(text, chr(10), 1), ' ')) + @len(@split(text, ' ')) AS n FROM {documents}"
_RESPONSES = (
    "SELECT doc_id, source, i + r AS n, md5(concat('b', doc_id)) AS h FROM "
    "(SELECT doc_id, source, @len(@split(split_part(text, chr(10), 1), ' ')) AS i, @len(@split(text, ' ')) AS r FROM {documents}) a WHERE r >= 8"
)

both("doc_byte_budget_prefix", f"SELECT doc_id, before + n AS cum FROM ({running(_BYTES, 'source', 'doc_id', 'n', _BLOCK)}) q WHERE before + n <= 50000")
both("doc_token_budget_prefix", f"SELECT doc_id, n FROM ({running(_WORDS, 'source', 'doc_id', 'n', _BLOCK)}) q WHERE before < 5000")
both("prepare_offsets", f"SELECT source, doc_id, before AS inst_start FROM ({running(_FRAMES, 'source', 'doc_id', 'n', _BLOCK)}) q")
both("sample_budget", f"SELECT source, doc_id FROM ({running(_RESPONSES, 'source', 'h, doc_id', 'n', 'substring(h, 1, 3)')}) q WHERE before < 4000")
both(
    "byte_cap_first_row",  # the flavour that always writes a first row
    f"SELECT doc_id, source FROM ({running(_BYTES, 'source', 'doc_id', 'n', _BLOCK)}) q WHERE before = 0 OR before + n <= 2000",
)
_LONG = "SELECT doc_id, source, @bytes(text) AS n FROM {documents} WHERE length(text) >= 20"
_CAPPED = f"SELECT doc_id, source, n, 0 AS whole FROM ({running(_LONG, 'source', 'doc_id', 'n', _BLOCK)}) c WHERE before < 40000"
both(
    "byte_capped_corpus",  # lines of 20 characters or more; each source stops at its cap, all at the total
    f"SELECT source, doc_id FROM ({running(_CAPPED, 'whole', 'source, doc_id', 'n', 'source')}) q WHERE before < 400000",
)
_DOCS = "SELECT doc_id, source, lang FROM {documents}"
both("epoch_permutation", " UNION ALL ".join(f"SELECT {e} AS epoch, pos, source, doc_id FROM ({ring(_DOCS, 'source', 'doc_id', f'7|{e}')}) e{e}" for e in (0, 1)))
both("quota_per_group", f"SELECT lang, doc_id FROM ({ring(_DOCS, 'lang', 'doc_id', 'q')}) q WHERE pos < CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 20 ELSE 10 END")
_PAIRED = ring("SELECT doc_id, toxic * 2 + quality AS kind FROM {labels}", "kind", "doc_id", "d")
both(
    "distractor_sampling",  # four others of a row's own kind, from all of them
    f"SELECT a.doc_id, o.doc_id AS other FROM (SELECT doc_id, kind, pos, size, @each(@seq(1, 4)) AS step FROM ({_PAIRED}) p) a JOIN ({_PAIRED}) o ON o.kind = a.kind AND o.pos = (a.pos + a.step) % a.size WHERE o.doc_id <> a.doc_id",
)
