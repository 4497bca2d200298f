"""All registered queries of the library: one key per operator of the survey, with its SQL where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    from . import all_queries  # noqa: F401  fills the tables

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import all_queries  # noqa: F401

    return dict(ORACLES)
