"""Named queries over the test tables, each with equivalent SQL where SQL can say it."""

from strataloom.catalog import draws, metrics, models, subjects, transforms  # noqa: F401
from strataloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
