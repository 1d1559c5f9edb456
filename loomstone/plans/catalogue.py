"""Every query of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from loomstone.plans import chain_queries, registry
from loomstone.plans import data_queries as _data  # noqa: F401
from loomstone.plans import text_queries as _text  # noqa: F401
from loomstone.plans.registry import Query

flagship = chain_queries.flagship


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
