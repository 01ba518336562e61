"""Queries over the test tables, each with the SQL that gives the same rows."""

from weftline.queries import algebra, analytics, inference, studies, vectors  # noqa: F401
from weftline.queries.base import QUERIES, SQL  # noqa: F401
