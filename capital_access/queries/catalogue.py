"""Imports every query module, so that all queries are registered."""

from capital_access.queries import aggregates, columns, composites, joins, scans  # noqa: F401
from capital_access.queries.registry import ORACLES, QUERIES  # noqa: F401
