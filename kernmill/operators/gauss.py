"""The Gauss transform by truncated Taylor series around cluster centers, and
small dense sketches that need linear algebra."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import Gaussian, Kernel
from . import sweep as sweep_module
from .cluster import assigned
from .sweep import copied, handed, linked, matrix, once, sqdist


def multi_indices(d: int, order: int) -> np.ndarray:
    """Exponents of all monomials of total degree below `order`, by degree."""
    rows = []
    for degree in range(order):
        for picks in combinations_with_replacement(range(d), degree):
            rows.append(np.bincount(np.array(picks, int), minlength=d))
    return np.array(rows, int).reshape(-1, d)


def monomials(x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(alpha)))
    for j in range(x.shape[1]):
        powers = np.vander(x[:, j], alpha[:, j].max(initial=0) + 1, increasing=True)
        out *= powers[:, alpha[:, j]]
    return out


def series(alpha: np.ndarray) -> np.ndarray:
    """2 ** |alpha| / alpha!"""
    return np.array([2.0 ** a.sum() / math.prod(math.factorial(int(v)) for v in a) for a in alpha])


def polynomial(alpha: np.ndarray, coef: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """monomials(x, alpha) @ coef as a function of x: the monomials of two halves of the variables meet by a matrix for each column."""
    half = alpha.shape[1] // 2
    (first, i), (second, j) = (np.unique(a, axis=0, return_inverse=True) if a.shape[1] else (np.zeros((1, 0), int), np.zeros(len(alpha), int)) for a in (alpha[:, :half], alpha[:, half:]))
    table = np.zeros((coef.shape[1], len(first), len(second)))
    table[:, i.ravel(), j.ravel()] = coef.T

    def value(x: np.ndarray) -> np.ndarray:
        left, right = monomials(x[:, :half], first), monomials(x[:, half:], second)
        return np.stack([np.einsum("nb,nb->n", left @ t, right) for t in table], axis=1)

    return value


def truncation(d: int, h: float, eps: float, radius: float, spread: float, most: int = 100) -> int:
    """The least order whose remainder, at clusters of a radius in data that
    spread so far in a dimension, is below eps."""
    reach = min(spread * math.sqrt(d), h * math.sqrt(math.log(1 / eps)))
    for p in range(1, most + 1):
        b = min((radius + math.sqrt(radius**2 + 2 * p * h * h)) / 2, radius + reach)
        log_error = p * math.log(max(2 * radius * b / h**2, 1e-300)) - math.lgamma(p + 1) - (radius - b) ** 2 / h**2
        if log_error <= math.log(eps):
            return p
    return most


#: Rows that the seeds of a transform are chosen from, and coefficients of all clusters and sets.
FIT, MOST_COEFFICIENTS = 1 << 16, 1 << 22
#: How the series are cut off: one order for all, one a cluster, or one a point, by distances from the centers.
ONE, BY_CLUSTER, BY_POINT = "one", "cluster", "point"


def farthest(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of farthest-point seeds, from the smallest id on, ties to the smaller id; fewer if all points are copies of them."""
    order = np.argsort(ids)
    x, picks = x[order], [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(picks) < k and near.max() > 0:
        picks.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[picks[-1]]) ** 2).sum(axis=1))
    return order[picks]


def gauss_transform(points: DataFrame, queries: DataFrame, h: float, eps: float, clusters: int, weights: Sequence[str] = ("w",), order: int | None = None, cut_off: str = ONE, copies: bool = True) -> DataFrame:
    """qid, wset, g: sum of weight * exp(-|x - q|^2 / h^2), each within eps times
    the sum of weights.

    Seeds are farthest points of a bounded sample; every point is assigned, and radii
    are measured over all points from the centers that the series use. A pass over the
    points adds up each cluster's coefficients, map-side first; they are bounded and
    broadcast. A pass over the queries evaluates the clusters within reach, each up to
    the order that its cut-off needs. Copies of many points and of many queries are
    put together first; copies: whether to look for them."""
    from .exact import together
    from .sampling import pick_set
    from .sweep import spread as over_cores

    points, queries, back = points.select("id", "x", *weights), queries.select("qid", "q"), None
    if copies and points.count() * queries.count() >= sweep_module.COPY_PAIRS:
        if copied(points, ["x"]):
            points = together(points, ["x"], weights).select("id", "x", *weights).persist()
        if places := copied(queries, ["q"]):
            queries, back = once(queries, places * len(weights))
    table = pick_set(points.select("id", "x"), FIT, "seeds").toArrow()
    if not table.num_rows:
        zero = F.explode(F.sequence(F.lit(0), F.lit(len(weights) - 1))).alias("wset")
        found = queries.select("qid", zero).withColumn("g", F.lit(0.0))
        return back(found) if back else found
    x = matrix(table.column("x"))
    centers = x[farthest(table.column("id").to_numpy(), x, clusters)]
    own = assigned(over_cores(points.select("id", "x", *weights), 64 * len(centers)), centers.tolist(), ("id", "x", *weights))
    radii = np.zeros(len(centers))
    for r in own.groupBy("cluster").agg(F.sqrt(F.max("dist2")).alias("r")).collect():
        radii[r["cluster"]] = r["r"]
    d, sets = centers.shape[1], len(weights)
    wide = points.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg((F.max("v") - F.min("v")).alias("s")).agg(F.max("s").alias("s")).first()["s"]
    p = order or truncation(d, h, eps, float(radii.max()), wide)
    if math.comb(p - 1 + d, d) * len(centers) * sets > MOST_COEFFICIENTS:
        raise ValueError(f"more than {MOST_COEFFICIENTS} coefficients: take fewer clusters, a larger eps, or a sweep")
    alpha = multi_indices(d, p)
    degree, c_alpha = alpha.sum(axis=1), series(alpha)
    steps = np.linspace(0.0, float(radii.max()), 33)[1:]  # upper edges of distances from a center
    orders = np.array([min(p, truncation(d, h, eps, float(r), wide)) for r in steps]) if cut_off == BY_POINT else None
    by_cluster = np.array([p if cut_off != BY_CLUSTER else min(p, truncation(d, h, eps, float(r), wide)) for r in radii])
    terms = np.searchsorted(degree, by_cluster)  # monomials stand by degree

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centers), len(alpha), sets))
        for b in batches:
            if not b.num_rows:
                continue
            x, k = matrix(b.column(0)), b.column(1).to_numpy()
            w = np.stack([b.column(2 + s).to_numpy(zero_copy_only=False).astype(float) for s in range(sets)], axis=1)
            for c in np.unique(k):
                rows, n = np.flatnonzero(k == c), terms[c]
                u = (x[rows] - centers[c]) / h
                size = (u * u).sum(axis=1)
                m = monomials(u, alpha[:n]) * np.exp(-size)[:, None]
                if orders is not None:
                    m[degree[None, :n] >= orders[np.minimum(np.searchsorted(steps, np.sqrt(size) * h), 31)][:, None]] = 0.0
                total[c, :n] += m.T @ w[rows]
        for c in np.flatnonzero(total.any(axis=(1, 2))):
            yield pa.RecordBatch.from_arrays([pa.array([int(c)] * sets, pa.int32()), pa.array(range(sets), pa.int32()), pa.array(total[c].T.tolist(), pa.list_(pa.float64()))], ["cluster", "wset", "c"])

    parts = own.select("x", "cluster", *weights).mapInArrow(coefficients, "cluster int, wset int, c array<double>")
    summed = parts.select("cluster", "wset", F.posexplode("c").alias("a", "v")).groupBy("cluster", "wset", "a").agg(F.sum("v").alias("v"))
    table = summed.toArrow()  # clusters x sets x monomials, up to MOST_COEFFICIENTS
    coef = np.zeros((len(centers), len(alpha), sets))
    coef[table.column("cluster").to_numpy(), table.column("a").to_numpy(), table.column("wset").to_numpy()] = table.column("v").to_numpy()
    coef *= c_alpha[:, None]
    shared = points.sparkSession.sparkContext.broadcast((centers, radii, alpha, coef, terms))
    reach = h * math.sqrt(math.log(1 / eps))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, radii, alpha, coef, terms = shared.value
        at = [polynomial(alpha[:n], c[:n]) for n, c in zip(terms, coef, strict=True)]
        for batch in batches:
            for b in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                q = matrix(b.column(1))
                d2 = sqdist(q, centers)
                met = d2 <= (reach + radii) ** 2
                g = np.zeros((len(q), sets))
                for c in np.flatnonzero(met.any(axis=0)):
                    near = np.flatnonzero(met[:, c])
                    g[near] += at[c]((q[near] - centers[c]) / h) * np.exp(-d2[near, c] / (h * h))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sets)), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(q))), pa.array(g.ravel())], ["qid", "wset", "g"])

    found = over_cores(queries.select("qid", "q"), len(centers) * len(alpha)).mapInArrow(evaluate, "qid long, wset int, g double")
    return back(found) if back else found


# ----------------------------------------------------------------- small sketches
MOST_DENSE = 4096


def _dense(points: DataFrame, n: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """A seeded sample of n rows on the driver, by id."""
    from .sampling import pick_set

    if n > MOST_DENSE:
        raise ValueError(f"a dense sketch takes at most {MOST_DENSE} rows")
    rows = pick_set(points.select("id", "x"), n, salt).orderBy("id").toArrow()
    return rows.column("id").to_numpy(), matrix(rows.column("x"))


def herding(points: DataFrame, kernel: Kernel, sample: int, m: int, salt: str = "herd") -> list[tuple[int, float]]:
    """(id, 1 / m) of m greedy picks from a sample: each maximises the sample's
    density less the mean kernel to the picks so far; ties to the smaller id."""
    ids, x = _dense(points, sample, salt)
    k = kernel.block(sqdist(x, x))
    density, run, out = k.mean(axis=1), np.zeros(len(x)), []
    for t in range(m):
        best = int(np.argmax(np.round(density - run / (t + 1), 12)))
        run += k[best]
        out.append((int(ids[best]), 1.0 / m))
    return out


def ska(points: DataFrame, kernel: Kernel, k: int, sample: int, salt: str = "ska") -> list[tuple[int, float]]:
    """(id, weight): farthest-point centers of a sample, weighted by the
    pseudo-inverse of their kernel matrix applied to the sample's mean kernels, and
    for the rest a uniform draw of the sample's rows; the parts are mixed in float
    arithmetic."""
    from ..functions.random import uniform_value

    ids, x = _dense(points, sample, salt)
    if not len(x):
        return []
    centers = k if k**3 <= len(x) else max(1, int(len(x) ** (1 / 3)))
    picks = farthest(ids, x, centers)
    gram = kernel.block(sqdist(x[picks], x[picks]))
    w = np.linalg.pinv(gram) @ kernel.block(sqdist(x[picks], x)).mean(axis=1)
    taken = set(picks.tolist())
    rest = sorted((i for i in range(len(x)) if i not in taken), key=lambda i: (uniform_value(int(ids[i]), f"{salt}-rest"), ids[i]))[: max(0, k - len(picks))]
    share = 1.0 / len(picks) if rest else 1.0
    return [(int(ids[i]), float(v) * share) for i, v in zip(picks, w, strict=True)] + [(int(ids[i]), (1 - share) / len(rest)) for i in rest]


#: Numbers of some columns that stay in a core's cache while a decomposition works on them.
COLUMN_TILE = 1 << 15


def interpolative(a: np.ndarray, rank: int | None = None, tolerance: float = 1e-6) -> tuple[list[int], np.ndarray]:
    """Skeleton columns and the matrix that rebuilds all columns from them, by
    pivoted Gram-Schmidt, to a rank or to a relative tolerance."""
    rest, picks = np.array(a.T, float, order="C"), []  # a column a row
    norms, step = np.einsum("ij,ij->i", rest, rest), max(1, COLUMN_TILE // max(1, rest.shape[1]))
    first = float(np.sqrt(norms.max(initial=0.0)))
    while len(picks) < min(rank or min(a.shape), *a.shape):
        j = int(np.argmax(norms))
        size = math.sqrt(max(norms[j], 0.0))
        if size <= (tolerance if rank is None else 1e-14) * max(first, 1e-300):
            break
        picks.append(j)
        v = rest[j] / size
        for k in range(0, len(rest), step):
            tile = rest[k : k + step]
            tile -= np.outer(tile @ v, v)
            norms[k : k + step] = np.einsum("ij,ij->i", tile, tile)
    return picks, np.linalg.lstsq(a[:, picks], a, rcond=None)[0] if picks else np.zeros((0, a.shape[1]))


@dataclass
class Treecode:
    """A space partition with a skeleton for each leaf, kept for any charges and targets.

    A leaf within `near` of a target is summed exactly; a farther one acts through at
    most `rank` skeleton points, whose charges an interpolative decomposition against
    sampled targets gives from those of the leaf's points. A leaf far from none of the
    sampled ones is near for all. Copies of many points, and of many targets, are put
    together: they share a place, and their charges add up."""

    placed: DataFrame  # id, x, leaf
    nodes: DataFrame  # leaf, id, x, center, radius, row (of the decomposition, over the leaf's points by id)
    kernel: Kernel
    near: float
    same: DataFrame | None = None  # id, first: of copies put together the smallest id
    back: Callable[[DataFrame], DataFrame] | None = None  # gives copies the rows of the first

    @classmethod
    def fit(cls, points: DataFrame, kernel: Kernel, depth: int, rank: int, near: float, samples: int = 256, copies: bool = True) -> Treecode:
        from ..storage import written
        from .cluster import space_partition
        from .sampling import pick_set

        d, points, same, back = len(points.select("x").first()["x"]), points.select("id", "x"), None, None
        if copies and points.count() ** 2 >= sweep_module.COPY_PAIRS and (places := copied(points, ["x"])):
            first, link = linked(points.select(F.col("id").alias("qid"), F.col("x").alias("q")), places)
            same, back = link.select(F.col("qid").alias("id"), "first"), partial(handed, link)
            points = first.select(F.col("qid").alias("id"), F.col("q").alias("x"))
        placed, _ = written(space_partition(points.select("id", "x"), depth, d, keep=("id", "x")), "placed")
        targets = matrix(pick_set(points.select("id", "x"), samples, "targets").select("x").toArrow().column("x"))
        shared = points.sparkSession.sparkContext.broadcast(targets)

        def skeleton(key: tuple, part: pa.Table) -> pa.Table:
            part = part.sort_by("id")
            x, ids = matrix(part.column("x")), part.column("id").to_numpy()
            center = x.mean(axis=0)
            radius = float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))
            far = shared.value[np.sqrt(((shared.value - center) ** 2).sum(axis=1)) > radius + near]
            if len(far):
                picks, build = interpolative(kernel.block(sqdist(far, x)), rank)
            else:
                picks, build, radius = [0], np.zeros((1, len(x))), float("inf")
            n = len(picks)
            return pa.table({"leaf": [key[0].as_py()] * n, "id": ids[picks], "x": x[picks].tolist(), "center": [center.tolist()] * n, "radius": [radius] * n, "row": build.tolist()})

        made = placed.repartition(1 << depth, "leaf").groupBy("leaf").applyInArrow(skeleton, "leaf long, id long, x array<double>, center array<double>, radius double, row array<double>")
        return cls(placed, written(made, "nodes")[0], kernel, near, same, back)

    def weighed(self, weights: DataFrame) -> DataFrame:
        """weights (id, w), those of copies that are put together added up, and kept."""
        weights = weights.select("id", "w")
        if self.same is None:
            return weights
        total = F.sum(F.coalesce(F.col("w").cast("double"), F.lit(float("nan"))))
        return weights.join(self.same, "id").groupBy(F.col("first").alias("id")).agg(total.alias("w")).persist()

    def charged(self, weights: DataFrame) -> DataFrame:
        """leaf, id, x, charge, center, radius of the skeletons under weights of weighed()."""

        def charge(key: tuple, nodes: pa.Table, own: pa.Table) -> pa.Table:
            w = own.sort_by("id").column("w").to_numpy().astype(float)
            return nodes.drop_columns(["row"]).append_column("charge", pa.array(matrix(nodes.column("row")) @ w if nodes.num_rows else np.empty(0)))

        own = self.placed.join(weights, "id").select("leaf", "id", "w")
        return self.nodes.groupBy("leaf").cogroup(own.groupBy("leaf")).applyInArrow(charge, "leaf long, id long, x array<double>, center array<double>, radius double, charge double")

    def balls(self) -> Broadcast:
        """(leaves, centers, radii), at most a row for each of 2 ** 16 leaves."""
        table = self.nodes.groupBy("leaf").agg(F.first("center").alias("center"), F.first("radius").alias("radius")).orderBy("leaf").toArrow()
        return self.placed.sparkSession.sparkContext.broadcast((table.column("leaf").to_numpy(), matrix(table.column("center")), table.column("radius").to_numpy()))

    def _near_field(self, asked: DataFrame, weights: DataFrame) -> DataFrame:
        """qid and p: the sums over the points of leaves, of queries (cell, qid, q) that name them."""
        from .cells import met
        from .exact import summing

        columns, schema, work = summing(weights, self.kernel, ["w"])
        there = self.placed.join(weights, "id").select(F.col("leaf").alias("cell"), *columns)
        return met(there, asked, work, schema).select("qid", F.col("sum").alias("p"))

    def potentials(self, queries: DataFrame, weights: DataFrame, copies: bool = True) -> DataFrame:
        """qid and potential of any targets under any weights (id, w) of the points. Skeletons are
        swept like points; a target goes to the leaves near it and meets their points there."""
        from .sweep import slices, sweep

        kernel, near, held, weights = self.kernel, self.near, self.balls(), self.weighed(weights)
        queries, back = queries.select("qid", "q"), None
        if copies and self.placed.count() * queries.count() >= sweep_module.COPY_PAIRS and (places := copied(queries, ["q"])):
            queries, back = once(queries, places)

        def far_field(qids: np.ndarray, q: np.ndarray, _: None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(q))
            for b in batches:
                x, charge, centers, radii = (f(b.column(k)) for k, f in ((1, matrix), (2, pa.Array.to_numpy), (3, matrix), (4, pa.Array.to_numpy)))
                for s in slices(len(q), x) if len(x) else ():
                    far = np.sqrt(sqdist(q, centers[s])) > radii[s] + near
                    total += (kernel.block(sqdist(q, x[s])) * far) @ charge[s]
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(total)], ["qid", "p"])

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, centers, radii = held.value
            for batch in batches:
                for b in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                    row, leaf = np.nonzero(np.sqrt(sqdist(matrix(b.column(1)), centers)) <= radii + near)
                    yield pa.RecordBatch.from_arrays([pa.array(names[leaf]), *b.take(pa.array(row)).columns], ["cell", "qid", "q"])

        far = sweep(self.charged(weights).select("id", "x", "charge", "center", "radius"), queries, far_field, "qid long, p double")
        kind = T.StructType([T.StructField("cell", T.LongType()), *queries.select("qid", "q").schema.fields])
        own = self._near_field(queries.select("qid", "q").mapInArrow(close, kind), weights)
        found = far.unionByName(own).groupBy("qid").agg(F.sum("p").alias("potential"))
        return back(found) if back else found

    def mutual_potentials(self, weights: DataFrame) -> DataFrame:
        """qid and potential of the points themselves under weights (id, w). Leaves act on
        leaves: the skeleton of one on that of another, if their balls are further apart than
        `near`, and the potentials of a skeleton are passed down to its leaf's points by the
        decomposition, which holds both ways as the kernel is symmetric."""
        from .sweep import slices, sweep

        kernel, near, held, weights = self.kernel, self.near, self.balls(), self.weighed(weights)
        charged = self.charged(weights).select("id", "x", "charge", "center", "radius")

        def at_skeletons(qids: np.ndarray, both: np.ndarray, own: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = both.shape[1] // 2
            q, middle, total = both[:, :d], both[:, d:], np.zeros(len(both))
            for b in batches:
                x, charge, centers, radii = (f(b.column(k)) for k, f in ((1, matrix), (2, pa.Array.to_numpy), (3, matrix), (4, pa.Array.to_numpy)))
                for s in slices(len(q), x) if len(x) else ():
                    far = np.sqrt(sqdist(middle, centers[s])) - own[:, None] > radii[s] + near
                    total += (kernel.block(sqdist(q, x[s])) * far) @ charge[s]
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(total)], ["qid", "u"])

        def down(key: tuple, nodes: pa.Table, own: pa.Table) -> pa.Table:
            p = nodes.column("u").to_numpy() @ matrix(nodes.column("row")) if nodes.num_rows else np.zeros(own.num_rows)
            return pa.table({"qid": own.sort_by("id").column("id"), "p": pa.array(p)})

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, centers, radii = held.value
            for batch in batches:
                for b in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                    own, which = np.unique(np.searchsorted(names, b.column(2).to_numpy()), return_inverse=True)
                    pairs = np.sqrt(sqdist(centers[own], centers)) - radii[own, None] <= radii + near
                    row, leaf = np.nonzero(pairs[which])
                    yield pa.RecordBatch.from_arrays([pa.array(names[leaf]), *b.select([0, 1]).take(pa.array(row)).columns], ["cell", "qid", "q"])

        asked = self.nodes.select(F.col("id").alias("qid"), F.concat("x", "center").alias("q"), "radius")
        felt = sweep(charged, asked, at_skeletons, "qid long, u double", "radius").groupBy("qid").agg(F.sum("u").alias("u"))
        nodes = self.nodes.join(felt.withColumnRenamed("qid", "id"), "id").select("leaf", "u", "row")
        far = nodes.groupBy("leaf").cogroup(self.placed.select("leaf", "id").groupBy("leaf")).applyInArrow(down, "qid long, p double")
        targets = self.placed.select(F.col("id").alias("qid"), F.col("x").alias("q"), "leaf")
        own = self._near_field(targets.mapInArrow(close, "cell long, qid long, q array<double>"), weights)
        found = far.unionByName(own).groupBy("qid").agg(F.sum("p").alias("potential"))
        return self.back(found) if self.back else found


def skeleton_transform(points: DataFrame, queries: DataFrame, kernel: Gaussian, depth: int, rank: int, near: float, samples: int = 256, weight: str = "w", copies: bool = True) -> DataFrame:
    """qid, potential: by a Treecode of the points, once. copies: whether to look for some."""
    return Treecode.fit(points, kernel, depth, rank, near, samples, copies).potentials(queries, points.select("id", F.col(weight).alias("w")), copies)
