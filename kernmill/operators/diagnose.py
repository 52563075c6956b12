"""Which estimator is cheaper: bounds on relative variance from the rings of a
query's contributions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..functions.scalar import collision
from ..storage import cut
from .order import sums_around
from .sweep import matrix, slices, sqdist, sweep

#: Contributions below it count for masses, not for ratios.
NEAR_ZERO = 1e-10


def contributions(points: DataFrame, queries: DataFrame, kernel: Kernel, width: float, power: int) -> DataFrame:
    """qid, id, c (kernel) and p (collision probability) of every pair; the query
    itself, where c >= 1, is left out. Pairs meet as in a sweep."""

    def work(qids: np.ndarray, q: np.ndarray, _: None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, ids = matrix(b.column(1)), b.column(0).to_numpy()
                for s in slices(len(q), x):
                    n = len(x[s])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.tile(ids[s], len(qids))), pa.array(sqdist(q, x[s]).ravel())], ["qid", "id", "d2"])

    d2 = F.col("d2")
    pairs = sweep(points.select("id", "x"), queries, work, "qid long, id long, d2 double")
    return pairs.select("qid", "id", kernel.column(d2).alias("c"), collision(F.sqrt(d2), width, F.lit(power)).alias("p")).where("c < 1")


def ringed(contrib: DataFrame, eps: float = 0.5, balanced: bool = True) -> DataFrame:
    """contrib with n, u (mean) and ring: 4 below the mean; then 3 from below and
    1 from above, each until it holds half of what is left of eps * u; 2 between.
    Not balanced: 4 below the mean and 1 above, and no others."""
    contrib = cut(contrib)  # all pairs, which are read three times
    out = contrib.join(contrib.groupBy("qid").agg(F.count("*").alias("n"), F.avg("c").alias("u")), "qid")
    if not balanced:
        return out.withColumn("ring", F.when(F.col("c") < F.col("u"), 4).otherwise(1))
    low = F.coalesce(F.sum(F.when(F.col("c") < F.col("u"), F.col("c"))), F.lit(0.0))
    share = out.groupBy("qid").agg(((F.lit(eps) * F.max("u") - low / F.max("n")) / 2).alias("_share"))
    high = sums_around(out.where("c >= u"), ["qid"], ["c", "id"], F.col("c")).join(share, "qid")
    ring = F.when(F.col("before") / F.col("n") < F.col("_share"), 3).when(F.col("after") / F.col("n") < F.col("_share"), 1).otherwise(2)
    return out.where("c < u").withColumn("ring", F.lit(4)).unionByName(high.select(*out.columns, ring.alias("ring")))


def ring_stats(rings: DataFrame) -> DataFrame:
    """qid, ring: number, mass, and extremes of c, c / p and c / p^2."""
    big = F.col("c") >= NEAR_ZERO
    of = lambda f, x: f(F.when(big, x))
    c, p = F.col("c"), F.col("p")
    return rings.groupBy("qid", "ring").agg(
        F.count("*").alias("cnt"), (F.sum("c") / F.max("n")).alias("mass"), (F.count("*") / F.max("n")).alias("share"),
        F.coalesce(of(F.max, c), F.lit(0.0)).alias("w_max"), F.coalesce(of(F.min, c), F.lit(1.0)).alias("w_min"), F.coalesce(of(F.min, p), F.lit(1.0)).alias("p_min"),
        of(F.max, c / p).alias("wp_max"), of(F.min, c / p).alias("wp_min"), of(F.max, c / p / p).alias("wpp_max"),
    )


def variance_bounds(stats: DataFrame) -> DataFrame:
    """qid, rs and hbe: bounds on the variance of uniform and of hashing-based
    sampling, over pairs of the first three rings and what the fourth adds. Of
    a ring with itself the hashing bound takes the extremes of both ratios,
    which is never below the search along the diagonal."""
    a = stats.where("ring < 4").select("qid", *[F.col(c).alias(f"a_{c}") for c in stats.columns if c != "qid"])
    b = stats.where("ring < 4").select("qid", *[F.col(c).alias(f"b_{c}") for c in stats.columns if c != "qid"])
    sup = (
        F.when(F.col("a_ring") == F.col("b_ring"), F.greatest(1 / F.col("a_p_min"), F.col("a_wpp_max") / F.col("a_wp_min")))
        .when(F.col("a_ring") < F.col("b_ring"), F.col("a_wpp_max") / F.col("b_wp_min"))
        .otherwise(F.col("a_wp_max") / F.col("b_w_min"))
    )
    mass = F.col("a_mass") * F.col("b_mass")
    pairs = a.join(b, "qid").groupBy("qid").agg(F.sum(F.col("a_w_max") / F.col("b_w_min") * mass).alias("rs"), F.sum(F.coalesce(sup, F.lit(0.0)) * mass).alias("hbe"))
    last = stats.where("ring = 4").select("qid", F.col("share").alias("t2"), F.col("w_max").alias("w4"), F.col("wp_max").alias("wp4"), F.col("mass").alias("u4"))
    single = a.join(last, "qid").groupBy("qid").agg(F.sum(F.col("t2") * F.col("a_w_max") * F.col("a_mass")).alias("rs1"), F.sum(F.coalesce(F.col("t2") * F.col("a_wpp_max"), F.lit(0.0)) * F.col("a_mass")).alias("hbe1"))
    out = pairs.join(single, "qid", "left").join(last, "qid", "left")
    zero = F.lit(0.0)
    return out.select(
        "qid", (F.col("rs") + F.coalesce("rs1", zero) + F.coalesce(F.col("w4") * F.col("u4"), zero)).alias("rs"),
        (F.col("hbe") + F.coalesce("hbe1", zero) + F.coalesce(F.col("wp4") * F.col("u4"), zero)).alias("hbe"),
    )


def actual_level(estimates: DataFrame, truth: DataFrame, last: int, eps: float) -> DataFrame:
    """qid, level: the first whose estimate is within eps of the truth; else the last."""
    good = F.abs(F.col("est") - F.col("density")) <= eps * F.col("density")
    return estimates.join(truth, "qid").groupBy("qid").agg(F.coalesce(F.min(F.when(good, F.col("level"))), F.lit(last)).alias("level"))


def scheme_bounds(points: DataFrame, queries: DataFrame, kernel: Kernel, schemes: dict[str, tuple[float, int]], eps: float = 0.5) -> DataFrame:
    """qid, scheme, rs and hbe: the bounds for several hashing schemes (width, power) at once."""
    each = (variance_bounds(ring_stats(ringed(contributions(points, queries, kernel, w, k), eps))).withColumn("scheme", F.lit(name)) for name, (w, k) in schemes.items())
    return reduce(DataFrame.unionByName, each).select("qid", "scheme", "rs", "hbe")


def best_scheme(bounds: DataFrame) -> DataFrame:
    """scheme and mean: of uniform sampling (`rs`) and all hashing schemes, by the mean bound, the least first."""
    each = bounds.groupBy("scheme").agg(F.avg("hbe").alias("mean")).unionByName(bounds.agg(F.avg("rs").alias("mean")).select(F.lit("rs").alias("scheme"), "mean"))
    return each.orderBy("mean", "scheme")
