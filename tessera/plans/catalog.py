"""All registered panel queries and their SQL twins."""

from __future__ import annotations

from . import align, cross, factors, fundamentals, live, reports, selection, storage, strategy, tuning, validation

_MODULES = (factors, fundamentals, cross, strategy, reports, live, align, selection, tuning, storage, validation)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
