"""The queries of this subpackage and the SQL they must agree with."""

from sieveline.llm import queries  # noqa: F401  (it registers its queries)
from sieveline.llm.binding import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
