"""Name -> (query, SQL) of the library's queries; SQL is None where it cannot express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(function: Query) -> Query:
        _REGISTERED[name or function.__name__] = (function, sql)
        return function

    return register


def typed(sql: str, **kinds: str) -> str:
    """The SQL with columns of given types, where its own would be decimals or wider integers."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {k}) AS {c}' for c, k in kinds.items())}) FROM ({sql})"


def registered_sql(name: str) -> str:
    """The SQL of a query that is registered, for another one to build on."""
    return _REGISTERED[name][1]


def registered() -> dict[str, tuple[Query, str | None]]:
    from . import modules  # noqa: F401  importing them registers their queries

    return dict(_REGISTERED)
