"""Collects the queries of all modules of this package with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import checks, datasets, grids, measures, puzzles, runs, series, texts, vectors
from .registry import QUERIES, SQL, Query

MODULES = (checks, datasets, grids, measures, puzzles, runs, series, texts, vectors)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Matched pairs of a factor grid, tested by signed ranks and adjusted within families."""
    return grids.signed_rank_tests(spark, folder)
