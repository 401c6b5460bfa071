"""All queries over the given tables, and the SQL that each is held against."""

from __future__ import annotations

from tidegrid.plans import shapes, stencils, streams, tables

PARTS = (stencils, shapes, tables, streams)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in PARTS for k, v in part.ORACLE.items()}
