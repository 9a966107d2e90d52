"""Named queries over the driver's tables, each beside an independent DuckDB statement.

``query(name, sql)`` registers a function ``(spark, sf_dir) -> DataFrame``;
modules that only hold registrations are imported at the bottom of this file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


from weftline.plans import bins  # noqa: E402, F401  registers its queries
from weftline.plans import rows  # noqa: E402, F401
from weftline.plans import reports  # noqa: E402, F401
from weftline.plans import measures  # noqa: E402, F401
from weftline.plans import loanbook  # noqa: E402, F401
from weftline.plans import shapes  # noqa: E402, F401
from weftline.plans import stores  # noqa: E402, F401
from weftline.plans import scores  # noqa: E402, F401
from weftline.plans import increments  # noqa: E402, F401
from weftline.plans import models  # noqa: E402, F401
from weftline.plans import dictionaries  # noqa: E402, F401
from weftline.plans import columns  # noqa: E402, F401
from weftline.plans import monitors  # noqa: E402, F401
from weftline.plans import modelreport  # noqa: E402, F401
