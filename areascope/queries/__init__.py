"""Queries over the driver tables, each beside its SQL counterpart."""

from areascope.queries import imagery, ingest, models, storage, summaries  # noqa: F401
from areascope.queries.base import QUERIES

__all__ = ["QUERIES"]
