"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from evifuse.plans.views import with_views

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


def _load() -> None:
    from evifuse.plans import analysis, candidates, documents, facts, fleet, lifecycle, listings, media, records, relations, streams  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
