"""Queries of the library's operators over the driver tables, with their SQL."""

from hopwright.plans import corpus_queries, driver_queries, simulation_queries

QUERIES = driver_queries.QUERIES | corpus_queries.QUERIES | simulation_queries.QUERIES
SQL = driver_queries.SQL | corpus_queries.SQL | simulation_queries.SQL

__all__ = ["QUERIES", "SQL"]
