"""All registered queries outside the training-data operators, with their DuckDB equivalents."""

from __future__ import annotations

from tabulon.queries import algorithms, arrays, elementwise, gradients, identities, large

MODULES = (elementwise, arrays, algorithms, gradients, identities, large)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
