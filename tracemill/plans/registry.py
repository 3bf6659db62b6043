"""All registered queries, gathered from the query modules."""

from . import chat, files, flows, keys, stats, text  # noqa: F401  (importing registers)
from .tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
