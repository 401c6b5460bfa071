"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from tidegrid.llm import queries_mining, queries_native, queries_text

QUERIES = {**queries_native.QUERIES, **queries_text.QUERIES, **queries_mining.QUERIES}
ORACLE = {**queries_native.ORACLE, **queries_mining.ORACLE}
