"""Every registered query and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "flagship"


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with its SQL where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


from stratagrid.plans import aggregates, bars, catalog, channels, contracts, cross_section, folds, kernels, lineage, rankings, refine, roles, selection, series, stores, streaming, technical, text, units, upkeep  # noqa: E402,F401
