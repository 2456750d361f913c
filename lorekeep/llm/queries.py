"""All queries of this package, by name, and their SQL."""

from __future__ import annotations

from . import q_leak, q_neardup, q_pack, q_setjoin, q_spans, q_split, q_terms

MODULES = [q_terms, q_setjoin, q_neardup, q_split, q_pack, q_leak, q_spans]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
