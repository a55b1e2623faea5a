"""Composite jobs and the registered queries with their DuckDB oracle SQL."""
