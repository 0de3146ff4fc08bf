"""All queries outside the llm subpackage."""

from __future__ import annotations

from sparkloom.plans import budgets, conversations, custom, draws, frames, matching, outlines, questions, records, rules, sqlplans, stores, streams, tabled, webpages  # noqa: F401
from sparkloom.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
