"""All queries of this package and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from granary.llm.oracles import ORACLES
from granary.llm.queries import Query
from granary.llm.queries import queries as own


def queries() -> dict[str, Query]:
    return own()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
