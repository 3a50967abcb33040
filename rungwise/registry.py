"""Every query of the library outside the ``llm`` subpackage, by name."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame and its SQL twin."""

    def put(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return put


def _load() -> None:
    from rungwise import plans  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark, sf_dir: str):
    return queries()["fused_rung_balance"](spark, sf_dir)
