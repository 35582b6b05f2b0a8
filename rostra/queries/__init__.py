"""Queries over the test tables, one or more for each operator."""

from rostra.queries import analytics, fixtures, retrieval, streams  # noqa: F401  (each registers its queries)
from rostra.queries.registry import QUERIES, SQL  # noqa: F401
