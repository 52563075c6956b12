"""Seeded sampling: with and without replacement, by weight, and permutations.

Every draw is a function of a key and a salt, so that it is the same on any
partitioning and a lost task repeats it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from .order import dense_index, prefix_sum


def pick_set(df: DataFrame, k: int, salt: str, id_: str = "id") -> DataFrame:
    """Exactly k distinct rows (all, if fewer), uniformly; each task sends its k smallest."""
    return df.withColumn("_u", uniform(id_, salt)).orderBy("_u", id_).limit(k).drop("_u")


def permuted(df: DataFrame, salt: str, id_: str = "id") -> DataFrame:
    """df with `row`, its place in a seeded permutation."""
    return dense_index(df.withColumn("_u", uniform(id_, salt)), ["_u", id_]).drop("_u")


def block(df: DataFrame, size: int, offset: int, salt: str, id_: str = "id") -> DataFrame:
    """A contiguous block of the permutation."""
    return permuted(df, salt, id_).where((F.col("row") >= offset) & (F.col("row") < offset + size)).drop("row")


def draws(spark, keys: DataFrame, m: int, n: int, salt: str) -> DataFrame:
    """(qid, r, row): m rows of n for each key, uniform with replacement."""
    reps = keys.select("qid").crossJoin(F.broadcast(spark.range(m).select(F.col("id").alias("r"))))  # m numbers
    u = uniform(F.concat_ws("/", F.col("qid").cast("string"), F.col("r").cast("string")), salt)
    return reps.withColumn("row", F.least(F.floor(u * n).cast("long"), F.lit(n - 1).cast("long")))


def weighted_draws(df: DataFrame, weight: str, m: int, salt: str, id_: str = "id") -> DataFrame:
    """(r, id): m independent draws in proportion to weight. Draws are m seeded
    uniforms, sorted and broadcast; every row looks up those that fall on it."""
    total = df.agg(F.sum(weight).alias("t")).first()["t"] or 0.0
    spark = df.sparkSession
    u = spark.range(m).select(uniform("id", salt).alias("u")).toArrow().column("u").to_numpy() * float(total)
    order = np.argsort(u, kind="stable")
    shared = spark.sparkContext.broadcast((u[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, which = shared.value
        for b in batches:
            low, w = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(at, low), np.searchsorted(at, low + w)
            n = last - first
            if n.sum():
                r = np.concatenate([which[s:e] for s, e in zip(first[n > 0], last[n > 0], strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.repeat(b.column(0).to_numpy(), n))], ["r", id_])

    low = prefix_sum(df.select(id_, F.col(weight).cast("double").alias("w")), [id_], F.col("w"), "low")
    return low.select(id_, "low", "w").mapInArrow(run, f"r long, {id_} long")
