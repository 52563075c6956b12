"""Bucket tables over a stream of points.

An extension: counts, weight sums and the race for a representative are sums and
minima, so a table is kept by incremental aggregation and always equals the one
built over all points at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.lsh import Hashes, buckets


def bucket_stream(points: DataFrame, hashes: Hashes, salt: str = "rep") -> DataFrame:
    """A streaming (tbl, key, cnt, wsum, rep_id), for the update or complete output mode."""
    return buckets(hashes.keys(points), salt=salt)
