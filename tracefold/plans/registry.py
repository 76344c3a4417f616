"""The registered queries of the diagnostic operators and the SQL that checks them."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
