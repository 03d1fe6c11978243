"""Query registry: plan modules add (spark builder, oracle SQL) pairs here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # Importing the plan modules fills the registry.
    from fathom.plans import browse_jobs, catalogue_jobs, file_jobs, listing_jobs, manifest_jobs, runfile_jobs, series_jobs, sql_suite  # noqa: F401
