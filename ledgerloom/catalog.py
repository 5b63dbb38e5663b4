"""The engine's own queries and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from .plans.queries import queries as own

    return own()


def oracle_sql() -> dict[str, str]:
    from .plans.oracles import oracle_sql as own

    return own()
