"""All queries of the engine itself, by name, and the SQL that checks them."""

from __future__ import annotations

from . import kernel, matching, metrics, reports, rhythm, runtime, signal, truth

_MODULES = (rhythm, signal, matching, metrics, runtime, kernel, truth, reports)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
