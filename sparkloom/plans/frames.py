"""Prepared samples with real ids: policies, frames, offsets, epochs, and batches for several ranks.

The default tokenizer gives each word the number that the first seven hex digits of its md5 spell,
so that SQL can check it; special ids are 1 (question begins), 2 (question ends), 3 (answer ends)
and 10 to 13 (conditions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.dialects import both, choose, ranges, ring, running, spell
from sparkloom.plans.sqlplans import plan
from sparkloom.registry import load, query
from sparkloom.session import written

#: Most tokens of a sample, and of the instruction's head that survives truncation.
CONTEXT, HEAD = 256, 96

_RANGE = ranges("doc_id", "{documents}")

# every document is a raw row: its first line instructs, the rest responds; some fields are missing or composite
_RAW = (
    f"SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {choose('substring_index', 'split_part')}(text, chr(10), 1) END AS instruction, "
    "CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN '  <think>only thought</think> ' ELSE text END AS response, "
    "CASE doc_id % 5 WHEN 0 THEN 'synth, cot' WHEN 1 THEN 'direct' WHEN 2 THEN 'noisy,direct' WHEN 3 THEN 'synth' ELSE 'weird' END AS given FROM {documents}"
)
_CONDITION = "CASE WHEN @has(labels, 'cot') THEN 'cot' WHEN @has(labels, 'synth') THEN 'synth' WHEN @has(labels, 'noisy') THEN 'noisy' WHEN @has(labels, 'direct') THEN 'direct' ELSE given END AS condition"
_STRIPPED = "trim(regexp_replace(response, @r'(?is)<think>.*?</think>\\s*', ''@all))"
_LABELS = "@map(@split(given, ','), @x trim(x))"
_CLEAN = (
    "SELECT doc_id, source, instruction, response, given, "
    f"{_CONDITION} "
    f"FROM (SELECT doc_id, source, instruction, {_STRIPPED} AS response, given, "
    f"{_LABELS} AS labels FROM ({_RAW}) a) b"
)
_WORDS = "filter(split({0}, '[ \\\\n]+'), w -> w <> '')"
_WORD_IDS = {
    0: "transform({0}, w -> CAST(conv(substring(md5(w), 1, 7), 16, 10) AS INT))",
    1: "list_transform(list_filter(regexp_split_to_array({0}, '[ \\n]+'), lambda w: w <> ''), lambda w: CAST('0x' || substring(md5(w), 1, 7) AS INT))",
}
# words of the instruction and of the response
_I, _R = choose("ni", "len(i0)"), choose("nr", "len(r0)")
_SLICE = {0: "concat(slice({0}, 1, {1}), slice({0}, greatest(size({0}) - {2}, 0) + 1, {2}))", 1: "list_concat(list_slice({0}, 1, {1}), list_slice({0}, greatest(len({0}) - {2}, 0) + 1, len({0})))"}
_FRAME = {
    0: "concat(array(1, {0}), {1}, array(2))",
    1: "list_concat([1, {0}], {1}, [2])",
}
_REPLY = {0: "concat({0}, array(3))", 1: "list_concat({0}, [3])"}
_CONDITION_ID = "CASE condition WHEN 'direct' THEN 10 WHEN 'synth' THEN 11 WHEN 'noisy' THEN 12 ELSE 13 END"
_HASH = {0: "md5(array_join({0}, ','))", 1: "md5(array_to_string({0}, ','))"}


def _counted() -> str:
    """Spark's raw rows with their condition and numbers of words, as ni and nr.

    inline() over one row computes each text once, where a filter would repeat its expression for every use.
    Numbers are exact up to CONTEXT words. Of longer texts no more is split off, so that their numbers only
    tell that they are longer: such a response is dropped, and such an instruction is cut to the room.
    """
    # a text may begin and end with an empty piece, so that a split that stops has two words above CONTEXT at least
    words = "filter(split({0}, '[ \\\\n]+', {1}), w -> w <> '')"
    sizes = ", ".join(f"size({words.format(x, CONTEXT + 4)}) AS {n}" for x, n in (("instruction", "ni"), ("response", "nr")))
    # a text without '<' has nothing to strip, which is told without a pattern
    stripped = f"CASE WHEN contains(response, '<') THEN {_STRIPPED} ELSE trim(response) END"
    cleaned = f"SELECT doc_id, source, instruction, given, x.response, x.labels FROM ({_RAW}) a LATERAL VIEW inline(array(struct({stripped} AS response, {_LABELS} AS labels))) x"
    return f"SELECT doc_id, source, instruction, response, given, {_CONDITION}, n.ni, n.nr FROM ({cleaned}) b LATERAL VIEW inline(array(struct({sizes}))) n"


def _encoded(k: int) -> str:
    """Every raw row with its fate; in DuckDB with all ids, in Spark with numbers of words, as ids are only wanted of rows that are written."""
    ids = _WORD_IDS[k]
    encoded = f"SELECT *, {ids.format('instruction')} AS i0, {ids.format('response')} AS r0 FROM ({_CLEAN}) c" if k else _counted()
    room = f"({CONTEXT} - {_R} - 4)"
    fate = (
        "CASE WHEN instruction IS NULL OR response IS NULL THEN 'missing field' WHEN condition NOT IN ('cot', 'synth', 'noisy', 'direct') THEN 'unknown condition' "
        f"WHEN response = '' OR {_R} < 1 THEN 'empty response' WHEN 4 + {_I} + {_R} <= {CONTEXT} THEN 'kept' WHEN {room} < 0 THEN 'response too long' ELSE 'truncated' END"
    )
    return spell(f"SELECT *, {room} AS room, {fate} AS fate FROM ({encoded}) e", k)


_WRITTEN = "WHERE fate IN ('kept', 'truncated')"


def written_rows() -> str:
    """Spark's rows that become samples, with their response as text and the words of their instruction."""
    return f"SELECT doc_id, source, condition, fate, room, response, {_WORDS.format('instruction')} AS i0 FROM ({_encoded(0)}) f {_WRITTEN}"


def framed(k: int, rows: str = "") -> str:
    """doc_id, source, inst and resp: the ids of each sample that is written; ``rows`` holds written_rows()."""
    head = f"least({HEAD}, CAST(floor(greatest(room, 0) / 2e0) AS INT))"
    cut = _SLICE[k].format("i0", head, f"(greatest(room, 0) - {head})")
    chosen = f"CASE WHEN fate = 'kept' THEN i0 ELSE {cut} END"
    if k:
        return f"SELECT doc_id, source, fate, {_FRAME[k].format(_CONDITION_ID, chosen)} AS inst, {_REPLY[k].format('r0')} AS resp FROM ({_encoded(k)}) f {_WRITTEN}"
    ids = f"SELECT doc_id, source, condition, fate, {_WORD_IDS[k].format('(' + chosen + ')')} AS i1, {_WORD_IDS[k].format(_WORDS.format('response'))} AS r1 FROM ({rows or written_rows()}) g"
    return f"SELECT doc_id, source, fate, {_FRAME[k].format(_CONDITION_ID, 'i1')} AS inst, {_REPLY[k].format('r1')} AS resp FROM ({ids}) h"


def lengths(k: int) -> str:
    """doc_id, source, inst_len and resp_len of each sample that is written; Spark takes them from numbers of words, without ids."""
    if k:
        return spell(f"SELECT doc_id, source, 0 AS whole, CAST(@len(inst) AS BIGINT) AS inst_len, CAST(@len(resp) AS BIGINT) AS resp_len FROM ({framed(k)}) g", k)
    return f"SELECT doc_id, source, 0 AS whole, CAST(3 + least(ni, room) AS BIGINT) AS inst_len, CAST(nr + 1 AS BIGINT) AS resp_len FROM ({_encoded(k)}) g WHERE fate IN ('kept', 'truncated')"


def spans(k: int, rows: str = "") -> str:
    """Where each sample's ids stand in the concatenation of all, in the order of doc_id; ``rows`` holds lengths(k)."""
    return f"SELECT doc_id, source, before AS inst_start, inst_len, before + inst_len AS resp_start, resp_len FROM ({running(rows or lengths(k), 'whole', 'doc_id', '(inst_len + resp_len)', _RANGE)}) q"


def _two(name: str, make) -> None:
    plan(name, spell(make(0), 0), spell(make(1), 1))


def _once(name: str, rows: Callable[[int], str], make: Callable[[int, str], str]) -> None:
    """Register make(k, rows), for which Spark computes ``rows`` once: sums and places within groups read them several times."""
    made, text = spell(rows(0), 0), spell(make(0, "SELECT * FROM {made}"), 0)

    @query(name, spell(make(1, rows(1)), 1).replace("{documents}", "documents"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = load(spark, sf_dir, "documents")
        tables = {"documents": docs} if "{documents}" in text else {}
        return spark.sql(text, made=written(spark.sql(made, documents=docs), name), **tables)


_two("frame_tokens", lambda k: spell(f"SELECT doc_id, fate, @len(inst) AS inst_len, @len(resp) AS resp_len, {_HASH[k].format('inst')} AS inst_md5, {_HASH[k].format('resp')} AS resp_md5 FROM ({framed(k)}) g", k))
_two("sample_policies", lambda k: f"SELECT fate, count(*) AS n FROM ({_encoded(k)}) g GROUP BY fate")
_two(
    "sample_policies_direct",  # unknown conditions become direct, long rows are dropped
    lambda k: spell(
        f"SELECT CASE WHEN fate = 'unknown condition' THEN CASE WHEN response = '' THEN 'empty response' WHEN 4 + {_I} + {_R} <= {CONTEXT} THEN 'kept' ELSE 'long' END "
        f"WHEN fate IN ('truncated', 'response too long') THEN 'long' ELSE fate END AS fate, count(*) AS n FROM ({_encoded(k)}) g GROUP BY 1",
        k,
    ),
)
# lengths alone do in Spark, where spans() would only add their places
_once("written_lengths", lengths, lambda k, rows: f"SELECT min(inst_len + resp_len) AS least, round(avg(inst_len + resp_len), 6) AS mean, max(inst_len + resp_len) AS most, CAST(sum(inst_len + resp_len) AS BIGINT) AS total_length FROM ({spans(k, rows) if k else rows}) g")
_once("v1_index", lengths, spans)
_once(
    "v1_epochs",  # two epochs over all samples, each in the order of its own hash
    lengths,
    lambda k, rows: " UNION ALL ".join(f"SELECT {e} AS epoch, pos, doc_id, inst_start, inst_len, resp_start, resp_len FROM ({ring('SELECT *, 0 AS whole FROM (' + spans(k, rows) + ') w', 'whole', 'doc_id', f'epoch{e}')}) e{e}" for e in (0, 1)),
)
_once(
    "v1_merge",  # the samples of a source stand after those of all sources before it by name
    lengths,
    lambda k, rows: f"""SELECT s.doc_id, s.source, CAST(s.before + b.base AS BIGINT) AS inst_start
FROM ({running(f'SELECT doc_id, source, inst_len + resp_len AS n FROM ({spans(k, rows)}) x', 'source', 'doc_id', 'n', _RANGE)}) s
JOIN (SELECT source, sum(t) OVER (ORDER BY source NULLS FIRST) - t AS base FROM (SELECT source, sum(inst_len + resp_len) AS t FROM ({spans(k, rows)}) y GROUP BY source) g) b ON s.source IS NOT DISTINCT FROM b.source""",
)
_once(
    "token_target_stop",  # rows until the target is reached, the crossing one included
    lengths,
    lambda k, rows: f"SELECT doc_id, inst_start FROM ({spans(k, rows)}) g WHERE inst_start < 20000",
)
_once(
    "budget_mix",  # every source is sampled to a budget, then all are put together; parts add up to the whole
    lengths,
    lambda k, rows: f"""SELECT source, count(*) AS samples, CAST(sum(n) AS BIGINT) AS tokens FROM (
{running(f"SELECT doc_id, source, inst_len + resp_len AS n, md5(concat('mix|', doc_id)) AS h FROM ({spans(k, rows)}) x", 'source', 'h, doc_id', 'n', 'substring(h, 1, 2)')}) s
WHERE before < 3000 GROUP BY ROLLUP(source)""",
)

# batches: samples in epoch order, eight to a batch, two ranks
_SAMPLES = "SELECT doc_id, 3 + quality AS i, 2 + toxic AS r, 0 AS whole FROM {labels}"
_PLACED = f"SELECT doc_id, i, r, CAST(floor(pos / 8e0) AS BIGINT) AS batch, pos % 2 AS rank, pos FROM ({ring(_SAMPLES, 'whole', 'doc_id', 'batch')}) p"
_TOKENS = (
    "SELECT batch, rank, pos, p, CAST(CASE WHEN p < i THEN 100 + p ELSE 200 + p - i END AS BIGINT) AS input, "
    f"CAST(CASE WHEN p + 1 < i THEN -100 ELSE 200 + p + 1 - i END AS BIGINT) AS label FROM (SELECT batch, rank, pos, i, r, @each(@seq(0, i + r - 2)) AS p FROM ({_PLACED}) a) b"
)
both(
    "batch_tensors",  # inputs, labels and positions of a rank's sequence, padded to 40
    "SELECT batch, rank, rpad(t.inputs || ',', 160, '0,') AS inputs, t.labels || repeat(',-100', CAST(40 - t.n AS INT)) AS labels, t.positions || repeat(',0', CAST(40 - t.n AS INT)) AS positions FROM "
    "(SELECT batch, rank, count(*) AS n, @cat(CAST(input AS STRING), ',' @by pos, p) AS inputs, @cat(CAST(label AS STRING), ',' @by pos, p) AS labels, @cat(CAST(p AS STRING), ',' @by pos, p) AS positions "
    f"FROM ({_TOKENS}) c GROUP BY batch, rank) t",
)
_ENDS = f"SELECT batch, rank, pos, CAST(sum(i + r - 1) OVER (PARTITION BY batch, rank ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq_end FROM ({_PLACED}) a"
both("batch_cu_seqlens", f"SELECT batch, rank, '0,' || @cat(CAST(seq_end AS STRING), ',' @by pos) AS cu_seqlens FROM ({_ENDS}) e GROUP BY batch, rank")
both("batch_efficiency", f"SELECT round(CAST(sum(n) AS DOUBLE) / (count(*) * 40), 9) AS used FROM (SELECT batch, rank, sum(i + r - 1) AS n FROM ({_PLACED}) a GROUP BY batch, rank) t")
both("batch_resume", f"SELECT batch, rank, doc_id FROM ({_PLACED}) a WHERE batch >= 3")
both(
    "segment_sums_by_ends",  # token hits of each sequence, found by the running ends
    f"""SELECT t.batch, t.rank, e.pos, CAST(sum(CASE WHEN t.label = t.input + 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, min(CASE WHEN t.label = t.input + 1 OR t.label = -100 THEN 1 ELSE 0 END) AS exact
FROM (SELECT *, row_number() OVER (PARTITION BY batch, rank ORDER BY pos, p) - 1 AS at FROM ({_TOKENS}) c) t
JOIN (SELECT *, seq_end - lag(seq_end, 1, 0) OVER (PARTITION BY batch, rank ORDER BY pos) AS n FROM ({_ENDS}) x) e
ON t.batch = e.batch AND t.rank = e.rank AND t.at < e.seq_end AND t.at >= e.seq_end - e.n GROUP BY t.batch, t.rank, e.pos""",
)
both(
    "masked_labels",  # prompt places are -100; rows are padded on the right to their batch's longest
    "SELECT doc_id, batch, repeat('-100,', CAST(i AS INT)) || repeat('7,', CAST(r AS INT)) || repeat('-100,', CAST(most - i - r AS INT)) AS labels, repeat('1,', CAST(i + r AS INT)) || repeat('0,', CAST(most - i - r AS INT)) AS mask "
    f"FROM (SELECT *, max(i + r) OVER (PARTITION BY batch) AS most FROM ({_PLACED}) a) b",
)
both("decode_excerpt", "SELECT doc_id, @join(@head(w, 1, 12), ' ') AS excerpt, @len(w) > 12 AS truncated FROM (SELECT doc_id, @split(text, ' ') AS w FROM {documents}) t")
both(
    "resume_step_offset",  # a stage begins where the one before ended
    "SELECT stage, steps, CAST(sum(steps) OVER (ORDER BY stage ROWS UNBOUNDED PRECEDING) - steps AS BIGINT) AS first_step FROM (VALUES (1, 300), (2, 120), (3, 80)) AS t(stage, steps)",
)
# every document's samples in batches of eight by hash: labels hold -100 over the prompt, rows are padded on the right to their batch's longest
_REPEAT = {0: "array_repeat({0}, CAST({1} AS INT))", 1: "list_transform(range(CAST({1} AS BIGINT)), lambda z: {0})"}
_CAT = {0: "concat({0})", 1: "list_concat({0})"}
_JOINED = {0: "md5(array_join({0}, ','))", 1: "md5(array_to_string({0}, ','))"}


def _padded_rows(k: int, rows: str) -> str:
    placed = spell(ring(f"SELECT doc_id, 0 AS whole, inst, resp FROM ({rows}) g", "whole", "doc_id", "sft"), k)
    sized = spell(f"SELECT doc_id, batch, inst, resp, @len(inst) AS i, @len(resp) AS r, max(@len(inst) + @len(resp)) OVER (PARTITION BY batch) AS most FROM (SELECT *, CAST(floor(pos / 8e0) AS BIGINT) AS batch FROM ({placed}) p) q", k)
    pad = lambda x: _REPEAT[k].format(x, "(most - i - r)")
    ids = _CAT[k].format(f"inst, resp, {pad(0)}")
    labels = _CAT[k].format(f"{_REPEAT[k].format(-100, 'i')}, resp, {pad(-100)}")
    mask = _CAT[k].format(f"{_REPEAT[k].format(1, '(i + r)')}, {pad(0)}")
    return f"SELECT doc_id, batch, most AS width, {_JOINED[k].format(ids)} AS ids_md5, {_JOINED[k].format(labels)} AS labels_md5, {_JOINED[k].format(mask)} AS mask_md5 FROM ({sized}) s"


_once("sft_padded_rows", framed, _padded_rows)
