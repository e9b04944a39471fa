"""All queries by name, and the SQL of those that have some."""

from vellumen.plans import queries_images, queries_pages, queries_records, queries_spans, queries_text  # noqa: F401  they register queries
from vellumen.plans.queries import QUERIES, SQL, UNREGISTERED, UNREGISTERED_SQL

__all__ = ["QUERIES", "SQL", "UNREGISTERED", "UNREGISTERED_SQL"]
