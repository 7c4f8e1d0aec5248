"""All queries by name, and their DuckDB twins."""

from __future__ import annotations

from . import dialogs, evaluation, geometry, prompts

_PARTS = (prompts, geometry, evaluation, dialogs)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
