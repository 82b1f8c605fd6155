"""All registered queries, in the order of the coverage inventory."""

from __future__ import annotations

from veritab.registry import base
from veritab.registry import (  # noqa: F401
    data_queries, edge_queries, history_queries, row_checks, streaming_queries, table_checks,
)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
