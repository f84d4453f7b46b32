"""Queries: operators applied to the Parquet tables of a data folder, with equivalent SQL."""

from crategraph.plans import core_queries, file_queries, scalar_queries, store_queries  # noqa: F401  register their queries
from crategraph.plans.catalog_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
