"""All registered queries and their SQL."""

from workload import (  # noqa: F401
    cleaning_queries,
    findings_queries,
    profile_queries,
    sources_queries,
    statistics_queries,
)
from workload.base import ORACLE, QUERIES  # noqa: F401
