"""All queries of the core in one place."""

from __future__ import annotations

from strataloom.plans import code, records, records_general, search

_MODULES = (code, records, search, records_general)


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
