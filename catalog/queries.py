"""All registered queries."""

from catalog import (
    associating,
    categories,
    cleaning,
    correlating,
    describing,
    findings,
    interacting,
    quality,
    reading,
    targets,
)
from catalog.registry import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "associating",
    "categories",
    "cleaning",
    "correlating",
    "describing",
    "findings",
    "interacting",
    "quality",
    "reading",
    "targets",
]
