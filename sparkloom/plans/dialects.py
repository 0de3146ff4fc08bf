"""One SQL text for Spark and DuckDB: words led by @ stand for what the dialects spell differently."""

from __future__ import annotations

import re
from typing import NamedTuple

from sparkloom.plans.sqlplans import plan

#: Spark's and DuckDB's word for each.
_WORDS = {
    "like": ("regexp_like", "regexp_matches"),
    "each": ("explode", "unnest"),
    "len": ("size", "len"),
    "split": ("split", "string_split"),
    "bytes": ("octet_length", "strlen"),
    "seq": ("sequence", "generate_series"),
    "all": ("", ", 'g'"),
    "r": ("r", ""),  # before a literal with backslashes
    "g1": ("'$1'", "'\\1'"),
    "map": ("transform", "list_transform"),
    "keep": ("filter", "list_filter"),
    "x": ("x ->", "lambda x:"),
    "xi": ("(x, i) ->", "lambda x, i:"),
    "i": ("i", "(i - 1)"),  # a lambda's index, from 0
    "join": ("array_join", "array_to_string"),
    "arr": ("array", "list_value"),
    "has": ("array_contains", "list_contains"),
    "at": ("try_element_at", "list_extract"),
    "head": ("slice", "list_slice"),  # from 1 only
    "cat": ("listagg", "string_agg"),
    "by": (") WITHIN GROUP (ORDER BY", " ORDER BY"),
    "pct": ("percentile", "quantile_cont"),
    "sha": ("sha2", "sha256"),
    "end256": (", 256)", ")"),
}


_CHOICE = re.compile("\x01([^\x01\x02\x03]*)\x02([^\x01\x02\x03]*)\x03")


def choose(spark: str, duck: str) -> str:
    """Text of which spell() takes one side; sides may hold further choices."""
    return f"\x01{spark}\x02{duck}\x03"


def spell(sql: str, k: int) -> str:
    while "\x01" in sql:
        sql = _CHOICE.sub(lambda m: m[k + 1], sql)
    return re.sub(r"@(\w+)", lambda m: _WORDS[m[1]][k], sql)


def both(name: str, sql: str) -> None:
    """Register a query whose text differs between the dialects by _WORDS alone."""
    plan(name, spell(sql, 0), spell(sql, 1))


class Ranges(NamedTuple):
    """Spark's text for quantile bounds of a key, and for the range between them that a row's key falls into."""

    bounds: str
    place: str

    def over(self, source: str) -> str:
        """Rows of ``source`` with bk, their range."""
        return f"SELECT * EXCEPT (bounds) FROM (SELECT *, {self.place} AS bk FROM (SELECT *, {self.bounds} AS bounds FROM ({source}) a) b) c"


def ranges(key: str, table: str, bits: int = 8) -> Ranges:
    """2**bits ranges of a number; nulls have a range of their own, -1.

    Bounds are quantiles of the key in ``table``, and are searched by halves, so that ranges hold about as
    many rows each whether ids are dense, hashed or clustered, and their number never grows.
    """
    n = 1 << bits
    shares = ", ".join(f"{k / n}D" for k in range(1, n))
    steps = ", ".join(str(1 << k) for k in reversed(range(bits)))
    bounds = f"(SELECT approx_percentile({key}, array({shares}), 4000) FROM {table})"
    return Ranges(bounds, f"CASE WHEN {key} IS NULL THEN -1 ELSE aggregate(array({steps}), 0, (at, step) -> if(bounds[at + step - 1] <= {key}, at + step, at)) END")


def running(source: str, by: str, order: str, value: str, bucket: str | Ranges) -> str:
    """Rows of ``source`` with ``before``, the sum of value over the rows of ``by`` that come before in ``order``, nulls first.

    In Spark a group is summed in buckets, which rise with the order: their totals are few, and no task
    sorts a whole group. DuckDB takes a plain window, which is what the buckets have to equal.
    """
    rising = ", ".join(f"{x.strip()} NULLS FIRST" for x in order.split(","))
    rows = bucket.over(source) if isinstance(bucket, Ranges) else f"SELECT *, {bucket} AS bk FROM ({source}) z"
    return choose(
        f"""
SELECT s.*, CAST(u.base + sum({value}) OVER (PARTITION BY s.{by}, s.bk ORDER BY {rising} ROWS UNBOUNDED PRECEDING) - {value} AS BIGINT) AS before
FROM ({rows}) s
JOIN (SELECT {by}, bk, sum(v) OVER (PARTITION BY {by} ORDER BY bk NULLS FIRST ROWS UNBOUNDED PRECEDING) - v AS base
      FROM (SELECT {by}, bk, sum({value}) AS v FROM ({rows}) y GROUP BY {by}, bk) t) u
ON s.{by} <=> u.{by} AND s.bk <=> u.bk""",
        f"SELECT *, CAST(sum({value}) OVER (PARTITION BY {by} ORDER BY {rising} ROWS UNBOUNDED PRECEDING) - {value} AS BIGINT) AS before FROM ({source}) z",
    )


def ring(source: str, by: str, key: str, seed: str) -> str:
    """Rows of ``source`` with pos, a row's place in its group ``by`` in the order of a hash of ``key``, and the group's size.

    Partners are found by place with an equi-join, so that the whole group is the pool and no pairs are
    made. Spark counts places in 4,096 buckets of the hash, DuckDB by a plain window.
    """
    h = f"md5(concat('{seed}|', coalesce(CAST({key} AS STRING), '')))"
    return choose(
        f"""
SELECT s.*, CAST(u.base + row_number() OVER (PARTITION BY s.{by}, s.bk ORDER BY s.h, s.{key} NULLS FIRST) - 1 AS BIGINT) AS pos, CAST(u.size AS BIGINT) AS size
FROM (SELECT *, {h} AS h, substring({h}, 1, 3) AS bk FROM ({source}) z) s
JOIN (SELECT {by}, bk, sum(v) OVER (PARTITION BY {by} ORDER BY bk ROWS UNBOUNDED PRECEDING) - v AS base, sum(v) OVER (PARTITION BY {by}) AS size
      FROM (SELECT {by}, substring({h}, 1, 3) AS bk, count(*) AS v FROM ({source}) y GROUP BY {by}, substring({h}, 1, 3)) t) u
ON s.{by} <=> u.{by} AND s.bk = u.bk""",
        f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY h, {key} NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY {by}) AS size FROM (SELECT *, {h} AS h FROM ({source}) y) z",
    )
