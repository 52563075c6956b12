"""Data generators: every value is a function of its row and a seed, so rows can
be made on any number of tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Exponential, Kernel
from ..functions.random import normal, uniform, uniform_value
from .sweep import matrix


def _vector(d: int, value) -> Column:
    """An array of value(j-th component's key suffix) over d components."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), value)


def normals(key: Column, d: int, salt: str) -> Column:
    return _vector(d, lambda j: normal(F.concat_ws("/", key.cast("string"), j.cast("string")), salt))


def uniforms(key: Column, d: int, salt: str) -> Column:
    return _vector(d, lambda j: uniform(F.concat_ws("/", key.cast("string"), j.cast("string")), salt))


def uniform_points(spark: SparkSession, n: int, d: int, salt: str = "u") -> DataFrame:
    return spark.range(n).select("id", uniforms(F.col("id"), d, salt).alias("x"))


def normal_points(spark: SparkSession, n: int, d: int, salt: str = "n") -> DataFrame:
    return spark.range(n).select("id", normals(F.col("id"), d, salt).alias("x"))


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """An orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Rotation:
    """A random rotation in a number of operations that grows with steps * d and not with
    d * d: each step turns seeded pairs of components by seeded angles."""

    d: int
    steps: int = 10
    salt: str = "rotation"

    def turns(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first components, second components, angles) by step."""
        out = []
        for s in range(self.steps):
            order = np.argsort([uniform_value(j, f"{self.salt}{s}") for j in range(self.d)])
            pairs = order[: self.d // 2 * 2].reshape(-1, 2)
            out.append((pairs[:, 0], pairs[:, 1], np.array([2 * math.pi * uniform_value(int(i), f"{self.salt}{s}a") for i in pairs[:, 0]])))
        return out

    def applied(self, points: DataFrame, back: bool = False) -> DataFrame:
        """id and x turned, or turned back."""
        turns = [(i, j, -a) for i, j, a in reversed(self.turns())] if back else self.turns()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1)).copy()
                for i, j, a in turns if len(x) else ():
                    first, second = x[:, i], x[:, j]
                    x[:, i], x[:, j] = first * np.cos(a) - second * np.sin(a), first * np.sin(a) + second * np.cos(a)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * self.d, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "x"])

        return points.select("id", "x").mapInArrow(run, "id long, x array<double>")


def transformed(points: DataFrame, matrix: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """x times a small matrix, plus a shift."""
    shift = np.zeros(matrix.shape[1]) if shift is None else shift
    cols = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in matrix[:, j]]), lambda a, b: a * b), F.lit(float(shift[j])), lambda s, v: s + v) for j in range(matrix.shape[1])]
    return points.withColumn("x", F.array(*cols))


def embedded(points: DataFrame, inner: int, d: int, seed: int = 5) -> DataFrame:
    """Low-dimensional points put into d dimensions and rotated."""
    return transformed(points, rotation(d, seed)[:inner])


def gaussian_points(spark: SparkSession, n: int, covariance: np.ndarray, mean: np.ndarray | None = None, salt: str = "g") -> DataFrame:
    return transformed(normal_points(spark, n, len(covariance), salt), np.linalg.cholesky(covariance).T, mean)


def mixture(spark: SparkSession, n: int, d: int, parts: int, spread: float = 0.1, means: str = "circle", salt: str = "m", covariances: list[np.ndarray] | None = None) -> DataFrame:
    """id, x, part: Gaussians about means on a circle, on the corners of the cube, or
    at random, of one spread or each part of its own covariance."""
    base = spark.range(n).withColumn("part", F.floor(uniform("id", f"{salt}p") * parts).cast("int"))
    if means == "circle":
        angle = F.col("part") * (2 * math.pi / parts)
        center = _vector(d, lambda j: F.when(j == 0, F.cos(angle)).when(j == 1, F.sin(angle)).otherwise(0.0))
    elif means == "cube":
        center = _vector(d, lambda j: F.pmod(F.floor(F.col("part") / F.pow(F.lit(2.0), j)), F.lit(2)).cast("double"))
    else:
        center = uniforms(F.col("part"), d, f"{salt}c")
    if covariances is None:
        return base.select("id", F.zip_with(center, normals(F.col("id"), d, salt), lambda c, z: c + z * spread).alias("x"), "part")
    factors = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.linalg.cholesky(c)]) for c in covariances])
    noise = F.transform(F.element_at(factors, F.col("part") + 1), lambda row: F.aggregate(F.zip_with(row, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return base.select("id", "part", normals(F.col("id"), d, salt).alias("z")).select("id", F.zip_with(center, noise, lambda c, e: c + e).alias("x"), "part")


def random_covariance(d: int, seed: int, least: float = 0.01, largest: float = 0.1) -> np.ndarray:
    """Of a random orientation, with variances between two bounds."""
    q = rotation(d, seed)
    return (q * np.random.default_rng(seed).uniform(least, largest, d)) @ q.T


def sphere_surface(spark: SparkSession, n: int, d: int, radius: float = 1.0, salt: str = "s") -> DataFrame:
    z = normals(F.col("id"), d, salt)
    size = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    return spark.range(n).select("id", z.alias("z")).select("id", F.transform("z", lambda v: v * radius / size).alias("x"))


def spheres(spark: SparkSession, n: int, d: int, count: int, salt: str = "b") -> DataFrame:
    """Points in `count` balls that don't overlap, along the first axis."""
    surface = sphere_surface(spark, n, d, 1.0, salt).withColumn("part", F.pmod(F.col("id"), F.lit(count)).cast("int"))
    radius = F.pow(uniform("id", f"{salt}r"), F.lit(1.0 / d)) * 0.45
    return surface.select("id", F.transform("x", lambda v, j: v * radius + F.when(j == 0, F.col("part").cast("double")).otherwise(0.0)).alias("x"), "part")


def line(spark: SparkSession, n: int, d: int, salt: str = "l") -> DataFrame:
    """Points on a random line through the origin."""
    return spark.range(n).select("id", F.transform(uniforms(F.lit("dir"), d, salt), lambda v: (v - 0.5) * (uniform("id", salt) * 2 - 1)).alias("x"))


@dataclass(frozen=True)
class Instance:
    """Clusters on unit directions at several scales of distance, so that the
    density at the origin has equal shares from each scale: `points` of density
    mass over each cluster and scale."""

    points: int
    clusters: int
    scales: int
    density: float
    d: int
    spread: float
    kernel: Kernel = Exponential()
    salt: str = "instance"

    def layout(self) -> list[tuple[int, float, int]]:
        """(scale, distance, points of each cluster)."""
        far = self.kernel.inverse(self.density)
        steps = [far * s / max(1, self.scales - 1) for s in range(self.scales)]
        value = {"Exponential": lambda r: math.exp(-r)}.get(type(self.kernel).__name__, lambda r: math.exp(-r * r))
        return [(s, r, max(1, math.floor(self.points * self.density / value(r)))) for s, r in enumerate(steps)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """id, x, cluster, scale."""
        out, base = None, 0
        for s, r, n in self.layout():
            own = spark.range(n * self.clusters).select((F.col("id") + base).alias("id"), F.expr(f"cast(id div {n} as int)").alias("cluster"), F.lit(s).alias("scale"))
            noise = self.spread * r / math.sqrt(self.d)
            x = F.zip_with(self.direction(F.col("cluster")), normals(F.col("id"), self.d, f"{self.salt}x"), lambda a, z: a * r + z * noise)
            own = own.select("id", x.alias("x"), "cluster", "scale")
            out, base = own if out is None else out.unionByName(own), base + n * self.clusters
        return out

    def direction(self, cluster: Column) -> Column:
        z = normals(cluster, self.d, f"{self.salt}d")
        return F.transform(z, lambda v: v / F.sqrt(F.aggregate(normals(cluster, self.d, f"{self.salt}d"), F.lit(0.0), lambda s, w: s + w * w)))

    def queries(self, spark: SparkSession, n: int, correlated: bool = True) -> DataFrame:
        """qid, q: along a cluster's direction, or in no particular one, at a seeded distance."""
        r = uniform("id", f"{self.salt}r") * self.kernel.inverse(self.density)
        if correlated:
            c = F.floor(uniform("id", f"{self.salt}c") * self.clusters).cast("int")
            own = spark.range(n).select("id", c.alias("c"), r.alias("r")).select(F.col("id").alias("qid"), F.transform(self.direction(F.col("c")), lambda v: v * F.col("r")).alias("q"))
            return own
        own = spark.range(n).select("id", r.alias("r"), normals(F.col("id"), self.d, f"{self.salt}q").alias("z"))
        return own.select(F.col("id").alias("qid"), F.transform("z", lambda v: v * F.col("r") / math.sqrt(self.d)).alias("q"))


def mixed_queries(instance: Instance, spark: SparkSession, n: int) -> DataFrame:
    """n correlated queries, and n uncorrelated ones after them."""
    free = instance.queries(spark, n, correlated=False).select((F.col("qid") + n).alias("qid"), "q")
    return instance.queries(spark, n).unionByName(free)


def sweep(spark: SparkSession, n: int, d: int, clusters: list[int], kernel: Kernel = Exponential(), scales: int = 4, spread: float = 0.001, density: float = 0.001) -> dict[int, DataFrame]:
    """Instances of about n points for each number of clusters."""
    return {c: i.frame(spark) for c, i in sweep_instances(n, d, clusters, kernel, scales, spread, density).items()}


def sweep_instances(n: int, d: int, clusters: list[int], kernel: Kernel = Exponential(), scales: int = 4, spread: float = 0.001, density: float = 0.001) -> dict[int, Instance]:
    return {c: Instance(max(1, n // (c * scales)), c, scales, density, d, spread, kernel, f"sweep{c}") for c in clusters}


def concat(parts: list[DataFrame]) -> DataFrame:
    """Instances below each other, ids made new: the part's number in the upper bits."""
    out = None
    for k, p in enumerate(parts):
        own = p.withColumn("id", F.col("id") + (k << 40))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
