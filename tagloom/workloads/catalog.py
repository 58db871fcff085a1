"""All registered queries; importing a family registers its queries."""

from tagloom.workloads import browse, duplicates, ingest, media, scalars, search, sets, tags  # noqa: F401
from tagloom.workloads.registry import QUERIES

__all__ = ["QUERIES"]
