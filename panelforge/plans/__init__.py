"""Composite plans (feature pipeline, train / test runs) and the registered
queries with their DuckDB oracle statements."""
