"""Registered jobs: one Spark plan and one DuckDB oracle text per query."""
