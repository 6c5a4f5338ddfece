"""All registered queries and their SQL."""

from saxframe.plans import declarations, verdicts  # noqa: F401
from saxframe.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
