"""All registered queries of the package without the training-data operators."""

from __future__ import annotations

from textloom.plans import model_queries, queries, store_queries  # noqa: F401  the modules register themselves

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
