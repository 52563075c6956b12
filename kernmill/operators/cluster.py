"""Clustering: farthest-point centers, Lloyd steps, balanced splits, and a space
partition by projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.random import uniform, uniform_value
from ..functions.vector import dot, literal, sqnorm
from ..functions.vector import sqdist as distance
from .sweep import matrix, slices, sqdist

#: Centers are few and live on the driver.
MOST_CENTERS = 4096


def kcenter(points: DataFrame, k: int, first: int | None = None, seeds: list[tuple[int, list[float]]] | None = None) -> list[tuple[int, list[float]]]:
    """Farthest-point seeds (id, x): from the point `first` (the smallest id, if
    none) or from given seeds on, always the point farthest from all seeds so far, ties to the
    smaller id; stops early once every point is a seed's copy. One aggregate a
    seed; nothing but seeds comes to the driver."""
    if k > MOST_CENTERS:
        raise ValueError(f"at most {MOST_CENTERS} centers")
    start = points.where(F.col("id") == first) if first is not None else points
    row = start.agg(F.min_by(F.struct("id", "x"), "id").alias("p")).first()["p"]
    if row is None:
        return []
    seeds = list(seeds) if seeds else [(row["id"], list(row["x"]))]
    while len(seeds) < k:
        centers = np.array([x for _, x in seeds])

        def farthest(batches: Iterator[pa.RecordBatch], centers: np.ndarray = centers) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                if b.num_rows:
                    x, ids = matrix(b.column(1)), b.column(0).to_numpy()
                    d = sqdist(x, centers).min(axis=1)
                    at = np.lexsort((ids, -d))[0]
                    if best is None or (-d[at], ids[at]) < best[:2]:
                        best = (-d[at], ids[at], x[at].tolist())
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([float(-best[0])]), pa.array([int(best[1])]), pa.array([best[2]], pa.list_(pa.float64()))], ["d", "id", "x"])

        local = points.select("id", "x").mapInArrow(farthest, "d double, id long, x array<double>")  # a row a task
        row = local.agg(F.max_by(F.struct("id", "x", "d"), F.struct("d", -F.col("id"))).alias("p")).first()["p"]
        if row["d"] <= 0:
            break
        seeds.append((row["id"], list(row["x"])))
    return seeds


def assigned(points: DataFrame, centers: list[list[float]], keep: tuple[str, ...] = ("id", "x")) -> DataFrame:
    """points with cluster (the nearest center, ties to the smaller number) and dist2."""
    table = np.array(centers, float)
    own = points.select("x", *[c for c in keep if c != "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            near, dist = np.empty(b.num_rows, np.int32), np.empty(b.num_rows)
            for s in slices(len(table), x):
                d = sqdist(x[s], table)
                near[s] = d.argmin(axis=1)
                dist[s] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(dist)], [*b.schema.names, "cluster", "dist2"])

    schema = T.StructType([*own.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("dist2", T.DoubleType())])
    return own.mapInArrow(run, schema)


def means(own: DataFrame, key: str = "cluster") -> DataFrame:
    """cluster, n and center: mean vectors, averaged by component with partial aggregates."""
    parts = own.select(key, F.posexplode("x").alias("j", "v")).groupBy(key, "j").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("j", "m")))
    return parts.groupBy(key).agg(F.max("n").alias("n"), F.transform(rows, lambda s: s["m"]).alias("center"))


def summary(points: DataFrame, seeds: list[tuple[int, list[float]]]) -> DataFrame:
    """cluster, center (mean), n and radius, measured from the mean that it is used with."""
    own = assigned(points, [x for _, x in seeds])
    center = means(own)
    far = own.join(F.broadcast(center), "cluster").groupBy("cluster").agg(F.sqrt(F.max(distance(F.col("x"), F.col("center")))).alias("radius"))
    return center.join(far, "cluster")


def lloyd(points: DataFrame, centers: list[list[float]], rounds: int = 20, tolerance: float = 1e-4) -> tuple[list[list[float]], float]:
    """k-means from given centers until the cost falls by less than the
    tolerance; a cluster without points keeps its center. Returns centers, cost."""
    cost = None
    for _ in range(rounds):
        own = assigned(points, centers)
        now = own.agg(F.sum("dist2").alias("c")).first()["c"] or 0.0
        if cost is not None and cost - now <= tolerance * cost:
            return centers, now
        cost = now
        for r in means(own).collect():
            centers = [*centers[: r["cluster"]], list(r["center"]), *centers[r["cluster"] + 1 :]]
    return centers, cost or 0.0


def balanced(points: DataFrame, k: int, folds: int = 3, salt: str = "fold", rounds: int = 20, tolerance: float = 1e-4) -> list[list[float]]:
    """Of several k-means runs from seeded rows the one with the most even sizes."""
    from .sampling import pick_set

    best = None
    for f in range(folds):
        rows = pick_set(points, k, f"{salt}{f}").select("x").collect()
        centers, _ = lloyd(points, [list(r["x"]) for r in rows], rounds, tolerance)
        sizes = [r["count"] for r in assigned(points, centers).groupBy("cluster").count().collect()]
        score = min(sizes) / max(sizes) if len(sizes) == k else 0.0
        if best is None or score > best[0]:
            best = (score, centers)
    return best[1]


def variance_ratio(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """One row: between (size-weighted squared distance of means to the global mean), within, ratio."""
    own = assigned(points, centers)
    center = means(own)
    whole = means(points.select(F.lit(0).alias("cluster"), "x")).select(F.col("center").alias("g"))
    within = own.join(F.broadcast(center), "cluster").agg(F.sum(distance(F.col("x"), F.col("center"))).alias("within"))
    between = center.crossJoin(whole).agg(F.sum(F.col("n") * distance(F.col("center"), F.col("g"))).alias("between"))
    return between.crossJoin(within).withColumn("ratio", F.col("between") / F.col("within"))


def seeds_by_distance(points: DataFrame, k: int, salt: str = "seed") -> list[list[float]]:
    """Seeding with probability in proportion to squared distance: a race of exponentials for each seed."""
    row = points.agg(F.min_by("x", uniform("id", f"{salt}0")).alias("x")).first()["x"]
    centers = [list(row)]
    while len(centers) < k:
        race = -F.log(uniform("id", f"{salt}{len(centers)}")) / F.col("dist2")
        found = assigned(points, centers).where("dist2 > 0").agg(F.min_by("x", F.struct(race, "id")).alias("x")).first()["x"]
        if found is None:
            break
        centers.append(list(found))
    return centers


def seeds_by_elimination(points: DataFrame, k: int, extra: int, salt: str = "seed") -> list[list[float]]:
    """k + extra seeds by distance, less those whose loss costs least, one by one."""
    centers = seeds_by_distance(points, k + extra, salt)
    while len(centers) > k:
        two = F.array_sort(F.array(*[F.struct(distance(F.col("x"), literal(c)).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centers)]))
        rows = points.select(two.alias("t")).select(F.col("t")[0]["k"].alias("k"), (F.col("t")[1]["d"] - F.col("t")[0]["d"]).alias("loss"))
        loss = {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.sum("loss").alias("s")).collect()}
        drop = min(range(len(centers)), key=lambda i: (loss.get(i, 0.0), i))
        centers = centers[:drop] + centers[drop + 1 :]
    return centers


# -------------------------------------------------------------- space partition
def projection(d: int, salt: str) -> list[float]:
    v = np.array([uniform_value(j, salt) - 0.5 for j in range(d)])
    return (v / np.linalg.norm(v)).round(9).tolist()


def _leaves(x: np.ndarray, cuts: list[dict[int, float]], salt: str, reach: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, leaf) pairs; with a reach, all leaves that a ball of it meets."""
    rows, leaf = np.arange(len(x)), np.ones(len(x), np.int64)
    for level, table in enumerate(cuts):
        t = x[rows] @ np.array(projection(x.shape[1], f"{salt}/{level}"))
        names = np.array(sorted(table))
        cut = np.array([table[k] for k in names.tolist()])[np.searchsorted(names, leaf)]
        low, high = t - reach <= cut, t + reach > cut
        rows, leaf = np.concatenate((rows[low], rows[high])), np.concatenate((leaf[low] * 2, leaf[high] * 2 + 1))
    return rows, leaf


def partition_cuts(points: DataFrame, depth: int, d: int, salt: str = "tree", accuracy: int | None = None) -> list[dict[int, float]]:
    """The medians of a space partition, by level and node: one aggregate a
    level, 2 ** level rows. accuracy: of approximate percentiles, for large
    data; none: exact medians."""
    if depth > 16:
        raise ValueError("at most 16 levels")
    out: list[dict[int, float]] = []
    for level in range(depth):
        known = list(out)

        def placed(batches: Iterator[pa.RecordBatch], known: list = known, level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0))
                    rows, leaf = _leaves(x, known, salt)
                    t = x[rows] @ np.array(projection(d, f"{salt}/{level}"))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(t)], ["leaf", "t"])

        own = points.select("x").mapInArrow(placed, "leaf long, t double").groupBy("leaf")
        middle = F.percentile("t", 0.5) if accuracy is None else F.percentile_approx("t", 0.5, accuracy)
        out.append({r["leaf"]: r["m"] for r in own.agg(middle.alias("m")).collect()})
    return out


def space_partition(points: DataFrame, depth: int, d: int, salt: str = "tree", keep: tuple[str, ...] = ("id", "x"), cuts: list[dict[int, float]] | None = None) -> DataFrame:
    """points with leaf (long, the path of bits below a leading one): on each
    level every node is split at its median along a seeded direction."""
    cuts = partition_cuts(points, depth, d, salt) if cuts is None else cuts
    own = points.select("x", *[c for c in keep if c != "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, leaf = _leaves(matrix(b.column(0)), cuts, salt)
                own = np.empty(b.num_rows, np.int64)
                own[rows] = leaf
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "leaf"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("leaf", T.LongType())]))


def variance_partition(points: DataFrame, depth: int, accuracy: int | None = None) -> DataFrame:
    """points with leaf, as space_partition(), each node split at the median of the component
    that varies most in it (ties: the first). Two aggregates a level, a row a node to the driver."""
    if depth > 16:
        raise ValueError("at most 16 levels")
    spark, cuts = points.sparkSession, []

    def placed(level: int) -> DataFrame:
        out = points.withColumn("leaf", F.lit(1).cast("long"))
        for table in cuts[:level]:
            out = out.join(F.broadcast(spark.createDataFrame(table, "leaf long, _j int, _m double")), "leaf")
            out = out.withColumn("leaf", F.col("leaf") * 2 + (F.element_at("x", F.col("_j") + 1) > F.col("_m")).cast("long")).drop("_j", "_m")
        return out

    for level in range(depth):
        own = placed(level)
        spreads = own.select("leaf", F.posexplode("x").alias("_j", "_v")).groupBy("leaf", "_j").agg(F.var_pop("_v").alias("_s"))
        widest = [(r["leaf"], r["j"]) for r in spreads.groupBy("leaf").agg(F.max_by("_j", F.struct("_s", -F.col("_j"))).alias("j")).collect()]
        if not widest:
            break
        value = own.join(F.broadcast(spark.createDataFrame(widest, "leaf long, _j int")), "leaf").select("leaf", "_j", F.element_at("x", F.col("_j") + 1).alias("t"))
        middle = F.percentile("t", 0.5) if accuracy is None else F.percentile_approx("t", 0.5, accuracy)
        cuts.append([(r["leaf"], r["_j"], r["m"]) for r in value.groupBy("leaf", "_j").agg(middle.alias("m")).collect()])
    return placed(len(cuts))


def routed(queries: DataFrame, cuts: list[dict[int, float]], salt: str = "tree", reach: float | None = None) -> DataFrame:
    """qid, leaf: the leaf of each query; with a reach, all leaves that its ball meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, leaf = _leaves(matrix(b.column(1)), cuts, salt, reach or 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(leaf)], ["qid", "leaf"])

    return queries.select("qid", "q").mapInArrow(run, "qid long, leaf long")


def equal_halves(points: DataFrame, direction: list[float]) -> DataFrame:
    """id, side: 0 up to the median of the projections, 1 above."""
    own = points.select("id", dot(F.col("x"), literal(direction)).alias("t"))
    return own.crossJoin(F.broadcast(own.agg(F.median("t").alias("m")))).select("id", (F.col("t") > F.col("m")).cast("int").alias("side"))


def diameter(points: DataFrame, tau: float) -> DataFrame:
    """One row: min(2 max |x|, ln(n / tau))."""
    return points.agg(F.least(2 * F.sqrt(F.max(sqnorm(F.col("x")))), F.log(F.count("*") / tau)).alias("diameter"))
