"""All registered queries."""

from scorewatch.plans import io_queries, quality_queries, record_queries  # noqa: F401
from scorewatch.plans.registry import ORACLE, QUERIES  # noqa: F401
