"""Statistics of points and error metrics of estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(points: DataFrame) -> DataFrame:
    """j, n, mean, low, high, sd (population), var (sample) and se of each component."""
    v = points.select(F.posexplode("x").alias("j", "v"))
    return v.groupBy("j").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_pop("v").alias("sd"), F.var_samp("v").alias("var"), (F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("se"))


def quantiles(rows: DataFrame, shares: dict[str, float], accuracy: int | None = None) -> DataFrame:
    """One row: of each column the value below which a share of the rows lies, between
    neighbours by interpolation; accuracy: of approximate ones, for large data."""
    of = lambda c, p: F.percentile(c, p) if accuracy is None else F.percentile_approx(c, p, accuracy)
    return rows.agg(*[of(c, p).alias(c) for c, p in shares.items()])


def rescaled(points: DataFrame, shift: str, by: str, of: DataFrame | None = None) -> DataFrame:
    """points with x less a statistic, over another (a statistic of zero: one). The statistics are a row a dimension,
    those of other points, if given."""
    s = column_stats(points if of is None else of).withColumn("range", F.col("high") - F.col("low"))
    rows = F.array_sort(F.collect_list(F.struct("j", F.col(shift).alias("a"), F.when(F.col(by) > 0, F.col(by)).otherwise(1.0).alias("b"))))
    one = F.broadcast(s.agg(rows.alias("_s")))
    return points.crossJoin(one).withColumn("x", F.zip_with("x", "_s", lambda v, r: (v - r["a"]) / r["b"])).drop("_s")


def zscored(points: DataFrame, of: DataFrame | None = None) -> DataFrame:
    return rescaled(points, "mean", "sd", of)


def unit_cube(points: DataFrame) -> DataFrame:
    return rescaled(points, "low", "range")


def relative_errors(estimates: DataFrame, truth: DataFrame, tau: float = 0.0) -> DataFrame:
    """qid, err: |est - density| over the density, or over tau if that is more."""
    base = F.greatest(F.col("density"), F.lit(tau))
    return estimates.join(truth, "qid").where(base > 0).select("qid", (F.abs(F.col("est") - F.col("density")) / base).alias("err"))


def error_report(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, mean, greatest and relative errors, and L2 and maximum norms of the differences over those of the truth."""
    d = F.abs(F.col("est") - F.col("density"))
    rel = F.when(F.col("density") != 0, d / F.abs("density"))
    return estimates.join(truth, "qid").agg(
        F.count("*").alias("n"), F.avg(rel).alias("mean_rel"), F.max(rel).alias("max_rel"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"),
        (F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("density") * F.col("density")))).alias("l2"), (F.max(d) / F.max(F.abs("density"))).alias("inf"),
        (F.stddev_pop(rel) / F.sqrt(F.count(rel))).alias("se_rel"),
    )


def halves(points: DataFrame, queries: DataFrame, kernel) -> DataFrame:
    """qid, first and second: densities under the rows of even and of odd ids, a check of a bandwidth."""
    from .exact import kernel_sums

    own = points.withColumn("half", F.pmod(F.col("id"), F.lit(2)).cast("int"))
    s = kernel_sums(own, queries, kernel, group="half")
    return s.groupBy("qid").agg(F.max(F.when(F.col("half") == 0, F.col("sum") / F.col("n"))).alias("first"), F.max(F.when(F.col("half") == 1, F.col("sum") / F.col("n"))).alias("second"))
