"""All queries of the library over the driver tables."""

from __future__ import annotations

from ionlake.plans import analysis_queries, extract_queries, table_queries, thinning_queries, trace_queries  # noqa: F401  (they register)
from ionlake.plans import saved_queries  # noqa: F401, I001  (after the others, whose SQL it takes)
from ionlake.plans.base import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
