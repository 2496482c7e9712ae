"""All registered queries, in one place."""

from sieveline.plans import output_bindings, table_bindings, text_bindings  # noqa: F401  (they register their queries)
from sieveline.plans.bindings import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
