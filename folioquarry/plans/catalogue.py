"""All registered queries of the library and their SQL."""

from __future__ import annotations

from folioquarry.plans import book_queries, grid_queries, operator_queries, page_queries, queries, scalar_queries, site_queries

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "book_queries", "grid_queries", "operator_queries", "page_queries", "queries", "scalar_queries", "site_queries"]
