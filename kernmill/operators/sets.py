"""Sets of ids and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def distinct(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of each, by all columns or by keys alone."""
    return rows.dropDuplicates(list(keys)) if keys else rows.dropDuplicates()


def difference(rows: DataFrame, forbidden: DataFrame, key: str = "id") -> DataFrame:
    """The distinct rows whose key is not among the forbidden ones; null keys are left out, as in SQL's `not in`."""
    return distinct(rows.where(rows[key].isNotNull()).join(forbidden.select(key), key, "left_anti"))


def complement(universe: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a universe whose key is not taken."""
    return universe.join(taken.select(key).distinct(), key, "left_anti")
