"""All queries of the core by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterloom.plans import dashboards, discovery, extraction, files, ingest, lookups, matching, people, ranking, reports, scalars, views

_ALL = views.QUERIES | reports.QUERIES | scalars.QUERIES | matching.QUERIES | ranking.QUERIES | people.QUERIES | discovery.QUERIES | ingest.QUERIES | dashboards.QUERIES | extraction.QUERIES | files.QUERIES | lookups.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of every institution: five aggregates joined to it."""
    return views.current_institutions(spark, sf_dir)
