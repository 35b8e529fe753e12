"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from trigrid.plans import matrix_queries, model_queries, problems

QUERIES = {**problems.QUERIES, **matrix_queries.QUERIES, **model_queries.QUERIES}
SQL = {**problems.SQL, **matrix_queries.SQL, **model_queries.SQL}
