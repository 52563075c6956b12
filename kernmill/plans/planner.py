"""What each way to a kernel sum costs on this engine, and the choice of a way.

A way is described by the work that it gives to the cluster: numbers that Arrow
tasks compute, bytes that move between tasks, and jobs that are started.  Rates turn
work into seconds; measured() takes them from the machine at hand."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Gaussian
from ..operators.gauss import truncation

#: Rows that a plan is made on: sources for distances and clusters, and targets.
PLAN_SOURCES, PLAN_TARGETS = 20_000, 64
#: Bytes of a partial sum on its way: query, weight set, sum, count.
PARTIAL = 28


@dataclass(frozen=True)
class Work:
    """differences: of single components; kernels: values of the kernel; products:
    multiplications with weights or monomials; moved: bytes; jobs: one after another."""

    differences: float = 0.0
    kernels: float = 0.0
    products: float = 0.0
    moved: float = 0.0
    jobs: float = 1.0


@dataclass(frozen=True)
class Rates:
    """Seconds of a core for one of each, and of the driver for a job."""

    differences: float = 2e-9
    kernels: float = 8e-9
    products: float = 1e-9
    moved: float = 1e-8
    jobs: float = 0.4


def measured(size: int = 512, d: int = 8) -> Rates:
    """Rates of numpy on this machine, for those that it decides."""
    from ..operators.sweep import sqdist

    x = np.random.default_rng(0).random((size, d))
    each = []
    for run in (lambda: sqdist(x, x), lambda k=Gaussian().block, s=sqdist(x, x): k(s), lambda s=sqdist(x, x): s @ x):
        run()
        began = time.perf_counter()
        for _ in range(4):
            run()
        each.append((time.perf_counter() - began) / 4)
    pairs = size * size
    return Rates(each[0] / (pairs * d), each[1] / pairs, each[2] / (pairs * d))


def seconds(work: Work, rates: Rates = Rates(), cores: int = 8) -> float:
    """Computing and moving are shared by the cores, jobs wait for each other."""
    w, r = asdict(work), asdict(rates)
    return sum(w[k] * r[k] for k in w if k != "jobs") / cores + w["jobs"] * r["jobs"]


def by_sweep(n: int, m: int, d: int, sets: int, tasks: int) -> Work:
    """All pairs; a partial sum for each query, set and task."""
    pairs = float(n) * m
    return Work(pairs * d, pairs, pairs * sets, float(tasks) * m * sets * PARTIAL, 2)


def by_cells(n: int, m: int, d: int, sets: int, near: float, cells: float, levels: int) -> Work:
    """Points and queries meet by leaves: `near` points for a query, which goes to `cells` leaves of `levels` levels."""
    pairs = near * m
    return Work(pairs * d + float(n + m) * levels * d, pairs, pairs * sets, 8.0 * n * (d + sets + 2) + cells * m * (8 * (d + 2) + sets * PARTIAL), 3 + levels)


def by_series(n: int, m: int, d: int, sets: int, clusters: int, monomials: int, met: float, tasks: int) -> Work:
    """Coefficients of each cluster from all points, and for each query those of the `met` clusters in reach."""
    assign = float(n) * clusters * (clusters + 1) / 2 + float(m) * clusters  # each seed is a pass
    return Work(assign * d, n + m * met, (n + m * met) * float(monomials) * (1 + sets), 8.0 * tasks * clusters * sets * monomials, clusters + 4)


def choose_method(points: DataFrame, queries: DataFrame, h: float, eps: float, weights: int = 1, rates: Rates = Rates(), cores: int = 8, sample: int = PLAN_SOURCES) -> dict:
    """The way with the least estimated seconds: sweep, cells or series, with the
    estimates. From a seeded sample of sources and targets come the share of points
    within reach and the clusters' radii; counts are of all rows."""
    from ..operators.cluster import kcenter, summary
    from ..operators.exact import kernel_sums
    from ..operators.sampling import pick_set

    n, m = points.count(), queries.count()
    d, tasks = len(points.select("x").first()["x"]), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = pick_set(points.select("id", "x"), sample, "plan").cache()
    targets = pick_set(queries.select("qid", "q"), PLAN_TARGETS, "plan", "qid")
    reach = h * math.sqrt(math.log(1 / eps))
    near = kernel_sums(sources, targets, Gaussian(h), radius=reach).agg(F.avg("n").alias("n")).first()["n"] or 0.0
    share = near / max(1, min(n, sample))
    found = summary(sources, kcenter(sources, max(2, min(40, math.isqrt(n))))).select("radius").collect()
    spread = sources.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg((F.max("v") - F.min("v")).alias("s")).agg(F.max("s").alias("s")).first()["s"]
    k, radius = len(found), max(r["radius"] for r in found)
    order = truncation(d, h, eps, radius, spread)
    met = 1 + (k - 1) * min(1.0, ((reach + radius) / max(spread, 1e-300)) ** min(d, 3))
    levels = max(1, min(16, int(math.log2(max(2, n / 2048)))))
    leaf = max(share, 2.0**-levels)
    works = {
        "sweep": by_sweep(n, m, d, weights, tasks),
        "cells": by_cells(n, m, d, weights, min(n, 2**d * leaf * n), min(2.0**levels, 2.0**d), levels),
        "series": by_series(n, m, d, weights, k, math.comb(order - 1 + d, d), met, tasks),
    }
    sources.unpersist()
    costs = {name: seconds(w, rates, cores) for name, w in works.items()}
    return {"method": min(costs, key=costs.get), "order": order, "clusters": k, **costs}


def choose_estimator(bounds: DataFrame) -> DataFrame:
    """One row: the mean relative variances rs and hbe, and which is less. bounds: qid, rs, hbe, density."""
    r2 = F.col("density") * F.col("density")
    return bounds.agg(F.avg(F.col("rs") / r2).alias("rs"), F.avg(F.col("hbe") / r2).alias("hbe")).withColumn("choice", F.when(F.col("hbe") < F.col("rs"), "hbe").otherwise("rs"))
