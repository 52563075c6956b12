"""Sampling estimators of kernel densities: uniform, hashing-based, sketches, and
the adaptive scheme over levels of density."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Gaussian, Kernel
from ..functions.random import uniform_value
from ..functions.scalar import collision, hash_power, hash_width
from ..functions.vector import sqdist
from ..storage import forget, written
from . import sweep
from .lsh import Hashes, buckets, scale_index, scale_step
from .order import dense_index
from .sampling import draws, permuted, weighted_draws


# ------------------------------------------------------------ uniform sampling
def random_sampling(points: DataFrame, queries: DataFrame, kernel: Kernel, m: int, salt: str = "rs", reservoir: int | None = None) -> DataFrame:
    """qid, est: the mean kernel over m rows drawn with replacement, from all
    points or from a reservoir of so many distinct ones; if m is the number of
    points, the exact mean."""
    from .exact import kde
    from .sampling import pick_set

    own = pick_set(points, reservoir, f"{salt}-reservoir") if reservoir else points
    n = own.count()
    if m == n:
        return kde(own, queries, kernel).withColumnRenamed("density", "est")
    rows = dense_index(own.select("id", "x"), ["id"])
    drawn = draws(points.sparkSession, queries, m, n, salt).join(rows, "row").join(_asked(queries), "qid")
    return drawn.groupBy("qid").agg(F.avg(kernel.column(sqdist(F.col("x"), F.col("q")))).alias("est"))


def _asked(queries: DataFrame) -> DataFrame:
    """qid and q, for a join by qid: broadcast up to BROADCAST_BYTES of vectors, else both sides are shuffled."""
    own = queries.select("qid", "q")
    size = own.agg((F.sum(F.size("q")) * 8).alias("b")).first()["b"] or 0
    return F.broadcast(own) if size <= sweep.BROADCAST_BYTES else own.hint("merge")


def floored(est: Column, low: float) -> Column:
    """Estimates below a bound count as zero."""
    return F.when(est < low, F.lit(0.0)).otherwise(est)


# ----------------------------------------------------- hashing-based estimators
def probe(table: DataFrame, points: DataFrame, queries: DataFrame, hashes: Hashes, kernel: Kernel, mass: Column, exact_collision: bool = False) -> DataFrame:
    """qid, est: over tables, the mean of kernel / collision probability * mass
    of the representative in the query's bucket; an empty bucket counts zero.
    table: buckets(); mass: of a bucket, as a share of all."""
    tables, power, _ = hashes.g.shape
    asked = hashes.keys(queries, "qid", "q")
    reps = table.select("tbl", "key", mass.alias("mass"), F.col("rep_id").alias("id")).join(points.select("id", "x"), "id")
    met = asked.join(reps, ["tbl", "key"], "left").join(_asked(queries), "qid")
    d2 = sqdist(F.col("x"), F.col("q"))
    z = kernel.column(d2) / collision(F.sqrt(d2), hashes.width, F.lit(power), exact_collision) * F.col("mass")
    per = met.groupBy("qid", "tbl").agg(F.sum(F.coalesce(z, F.lit(0.0))).alias("z"))  # scales of a bucket add up
    return per.groupBy("qid").agg((F.sum("z") / tables).alias("est"))


def hbe_uniform(points: DataFrame, queries: DataFrame, hashes: Hashes, kernel: Kernel, salt: str = "rep", exact_collision: bool = False, subsample: int | None = None) -> DataFrame:
    """Tables over all points, each bucket with its count and a uniform member;
    with a subsample, each table over a block of so many rows of one permutation."""
    n = points.count()
    keyed = hashes.keys(points)
    if subsample and 1 < subsample < n:
        starts = [int(uniform_value(t, f"{salt}-block") * (n - subsample)) for t in range(hashes.g.shape[0])]
        begin = F.element_at(F.array(*map(F.lit, starts)), F.col("tbl") + 1)
        keyed = keyed.join(permuted(points.select("id"), f"{salt}-perm"), "id").where((F.col("row") >= begin) & (F.col("row") < begin + subsample))
        n = subsample
    return probe(buckets(keyed, salt=salt), points, queries, hashes, kernel, F.col("cnt") / F.lit(float(n)), exact_collision)


def hbe_weighted(points: DataFrame, queries: DataFrame, hashes: Hashes, kernel: Kernel, weight: str, scale: Column | None = None, salt: str = "rep") -> DataFrame:
    """Tables over weighted points, a representative drawn by weight in each
    bucket (and weight scale); estimates sum(w k) / n."""
    n = points.count()
    more = [F.col(weight).alias("_w"), *([scale.alias("scale")] if scale is not None else [])]
    keyed = hashes.keys(points).join(points.select("id", *more), "id")
    table = buckets(keyed, "_w", "scale" if scale is not None else None, salt)
    return probe(table, points, queries, hashes, kernel, F.col("wsum") / F.lit(float(n)))


def hbe_sketch(points: DataFrame, queries: DataFrame, hashes: Hashes, sketches: Sequence[Hashes | DataFrame], kernel: Kernel, m: int, salt: str = "hs", scales: int | None = None) -> DataFrame:
    """Tables over m weighted draws each, from the sketches in turn. A sketch is one
    table of hashes over the points, or given as (id, prob, weight). scales: buckets by
    the scale of a draw's weight, too, so many between the least and the largest."""
    drawn = None
    for k, sketch in enumerate(sketches):
        members = (sketch_members(points, sketch) if isinstance(sketch, Hashes) else sketch).select("id", "prob", "weight")
        for t in range(k, hashes.g.shape[0], len(sketches)):
            own = weighted_draws(members, "prob", m, f"{salt}{t}").join(members.select("id", "weight"), "id").select("id", F.lit(t).alias("tbl"), "weight")
            drawn = own if drawn is None else drawn.unionByName(own)
    each = drawn.groupBy("id", "tbl").agg(F.sum("weight").alias("_w"), F.max("weight").alias("_one"))
    keyed = each.join(hashes.keys(points), ["id", "tbl"])
    if scales:
        low, high = each.agg(F.min("_one"), F.max("_one")).first()
        keyed = keyed.withColumn("scale", scale_index(F.col("_one"), low or 1.0, scale_step(low or 1.0, high or 1.0, scales)))
    return probe(buckets(keyed, "_w", "scale" if scales else None, salt=salt), points, queries, hashes, kernel, F.col("wsum") / float(m))


# --------------------------------------------------------------------- sketches
@dataclass(frozen=True)
class SketchRule:
    """Bucket probabilities size ** gamma: gamma balances the largest bucket
    against the density bound tau, unless buckets are many."""

    tau: float = 0.001
    spread: float = 1.1
    many: float = 890.9

    def gamma(self, number: int, largest: int, n: int) -> float:
        if number > self.many or largest <= self.tau * n:
            return 1.0
        return 1.0 - math.log(self.spread) / math.log(largest / (self.tau * n))


def sketch_members(points: DataFrame, hashes: Hashes, rule: SketchRule = SketchRule()) -> DataFrame:
    """id, size (of its bucket), prob (of being drawn) and weight (of a draw, so
    that weighted draws are unbiased) under one table."""
    keyed = hashes.keys(points).where("tbl = 0")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"))
    s = sizes.agg(F.count("*").alias("b"), F.max("size").alias("m"), F.sum("size").alias("n")).first()
    if not s["b"]:
        return keyed.select("id", F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("prob"), F.lit(0.0).alias("weight"))
    gamma = rule.gamma(s["b"], s["m"], s["n"])
    total = sizes.agg(F.sum(F.pow("size", F.lit(gamma))).alias("t")).first()["t"]
    prob = F.pow("size", F.lit(gamma)) / total / F.col("size")
    return keyed.join(sizes, "key").select("id", "size", prob.alias("prob"), (1.0 / (prob * s["n"])).alias("weight"))


def hbs_sketch(points: DataFrame, hashes: list[Hashes], m: int, salt: str = "hbs") -> DataFrame:
    """method, id, weight: m draws shared out over the tables, the rest to the
    first; each table stands over its own uniform rows, twice a table's share of all."""
    from .sampling import pick_set

    n, out = points.count(), None
    for k, h in enumerate(hashes):
        own = m // len(hashes) + (m % len(hashes) if k == 0 else 0)
        size = 2 * n // len(hashes)
        members = sketch_members(pick_set(points.select("id", "x"), size, f"{salt}{k}-rows") if size < n else points, h)
        drawn = weighted_draws(members, "prob", own, f"{salt}{k}").join(members.select("id", "weight"), "id")
        part = drawn.select(F.lit("hbs").alias("method"), F.lit(k).alias("tbl"), "r", "id", (F.col("weight") / F.lit(float(m))).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_sketch(sketch: DataFrame, points: DataFrame, queries: DataFrame, kernel: Kernel) -> DataFrame:
    """qid, est: sum of weight times kernel over a sketch's rows."""
    from .exact import kernel_sums

    rows = sketch.groupBy("id").agg(F.sum("weight").alias("w")).join(points.select("id", "x"), "id")
    return kernel_sums(rows, queries, kernel, weights=["w"]).select("qid", F.col("sum").alias("est"))


def median_of_sketches(sketches: list[DataFrame], points: DataFrame, queries: DataFrame, kernel: Kernel) -> DataFrame:
    """qid, est: the median over several sketches' estimates."""
    out = None
    for s in sketches:
        e = evaluate_sketch(s, points, queries, kernel)
        out = e if out is None else out.unionByName(e)
    return out.groupBy("qid").agg(F.median("est").alias("est"))


# --------------------------------------------------------------------- adaptive
@dataclass(frozen=True)
class Level:
    level: int
    mu: float
    m: int
    t: float
    k: int
    w: float


def levels(tau: float, eps: float, kernel: Kernel | None = None, diameter: float | None = None, beta: float = 0.5) -> list[Level]:
    """Densities 1/2, 1/4 ... down to tau, with the samples that each needs:
    uniform sampling without a kernel, else hashing with its width and power."""
    out = []
    r = math.sqrt(math.log(1 / tau))
    for i in range(math.ceil(math.log2(1 / tau))):
        mu = 2.0 ** -(i + 1)
        if kernel is None:
            out.append(Level(i, mu, math.ceil((1 / mu) / eps**2), 0.0, 0, 0.0))
            continue
        m = math.ceil(kernel.relative_variance(mu) / eps**2)
        if isinstance(kernel, Gaussian):
            t = math.sqrt(math.log(1 / mu))
            k = math.floor(3 * math.ceil(r * t))
            out.append(Level(i, mu, m, t, k, k / t * math.sqrt(2 / math.pi)))
        else:
            k = hash_power(diameter or math.log(1 / tau), beta)
            out.append(Level(i, mu, m, 0.0, k, hash_width(k, beta)))
    return out


def level_frame(spark, table: list[Level]) -> DataFrame:
    rows = ", ".join(f"({x.level}, {x.mu!r}D, {x.m}, {x.t!r}D, {x.k}, {x.w!r}D)" for x in table)
    return spark.sql(f"select * from values {rows} as t(level, mu, m, t, k, w)")


def relaxation_levels(tau: float, eps: float, kernel: Kernel | None = None) -> list[Level]:
    """Levels of mean relaxation: densities 1, 1/2 ... with samples 3 ceil(V /
    eps^2) for hashing, or floor(12 / (eps^2 mu)) from 1/2 on for uniform draws."""
    if kernel is None:
        return [Level(i, 2.0 ** -(i + 1), int(12 / eps**2 * 2 ** (i + 1)), 0.0, 0, 0.0) for i in range(math.ceil(math.log2(1 / (eps * tau))))]
    out, r = [], math.sqrt(math.log(1 / tau))
    for i in range(math.ceil(math.log2(1 / tau)) + 1):
        mu = 2.0**-i
        v = kernel.relative_variance(mu, 0.75) if isinstance(kernel, Gaussian) else kernel.relative_variance(mu)
        t = math.sqrt(math.log(1 / mu)) / 2
        k = 3 * math.ceil(r * t)
        out.append(Level(i, mu, 3 * math.ceil(v / eps**2), t, k, k / t * math.sqrt(2 / math.pi) if k else 1.0))
    return out


#: Of a level and the queries that are open there the estimates (qid, est). Whatever has this form can be run adaptively.
LevelEstimate = Callable[[Level, DataFrame], DataFrame]


def mean_of_means(draw: Callable[[DataFrame, int, str], DataFrame], queries: DataFrame, m: int, groups: int = 1, low: float = 0.0, salt: str = "mom") -> DataFrame:
    """qid, est: the median over `groups` of the means of m values each, estimates
    below `low` as zero. draw(queries, m, salt) gives (qid, est), a mean of m values."""
    parts = reduce(DataFrame.unionByName, (draw(queries, m, f"{salt}/{g}") for g in range(groups)))
    return parts.groupBy("qid").agg(floored(F.median("est"), low).alias("est"))


def adaptive(queries: DataFrame, table: list[Level], n: int, estimate: LevelEstimate, cost: Callable[[Level], int], gamma: float = 0.5, skip: bool = True) -> DataFrame:
    """qid, est, samples, level.

    From the first level on: stop if the estimate reaches the level's density or
    the level would sample more than all rows; else go on to the level that the
    estimate suggests, the next one at least. An estimate of zero goes to the next.
    skip: without it only the estimate stops, and levels follow one by one.
    A level is estimated for the queries that are open there, and no others; what is
    known of all is kept in a table in the shared folder from level to level."""
    spark = queries.sparkSession
    asked = queries.select("qid", "q")
    start = asked.select("qid", F.lit(0).alias("next"), F.lit(0.0).alias("est"), F.lit(0).cast("long").alias("samples"), F.lit(-1).alias("level"))
    now, path = written(start, "adaptive")
    while (at := now.agg(F.min("next").alias("i")).first()["i"]) is not None and at < len(table):
        x = table[at]
        here = asked.join(now.where(F.col("next") == at).select("qid"), "qid", "left_semi")
        found = estimate(x, here).select("qid", F.col("est").alias("_found"))
        on = F.coalesce(F.col("next") == at, F.lit(False))
        stop = (F.col("_e") >= x.mu) | F.lit(skip and cost(x) > n)
        jump = F.when(F.col("_e") > 0, F.floor(F.log("_e") / math.log(1 - gamma)).cast("int")).otherwise(at + 1) if skip else F.lit(at + 1)
        moved = F.when(stop, F.lit(None).cast("int")).otherwise(F.greatest(jump, F.lit(at + 1)))
        after = now.join(found, "qid", "left").withColumn("_e", F.coalesce("_found", F.lit(0.0))).select(
            "qid", F.when(on, moved).otherwise(F.col("next")).alias("next"), F.when(on, F.col("_e")).otherwise(F.col("est")).alias("est"),
            F.when(on, F.col("samples") + cost(x)).otherwise(F.col("samples")).alias("samples"), F.when(on, F.lit(at)).otherwise(F.col("level")).alias("level"),
        )
        before, (now, path) = path, written(after, "adaptive")
        forget(spark, before)
    return now.select("qid", "est", "samples", "level")


def rs_level(points: DataFrame, kernel: Kernel, n: int, groups: int = 3, salt: str = "ars") -> LevelEstimate:
    """The median of `groups` means of uniform draws, as many as the level asks for."""
    rows = dense_index(points.select("id", "x"), ["id"])

    def estimate(x: Level, queries: DataFrame) -> DataFrame:
        d = draws(points.sparkSession, queries, x.m * groups, n, f"{salt}{x.level}").join(rows, "row").join(_asked(queries), "qid")
        mean = d.groupBy("qid", F.expr(f"r div {x.m}").alias("grp")).agg(F.avg(kernel.column(sqdist(F.col("x"), F.col("q")))).alias("e"))
        return mean.groupBy("qid").agg(F.median("e").alias("est"))

    return estimate


def rs_levels(points: DataFrame, queries: DataFrame, kernel: Kernel, table: list[Level], n: int, groups: int = 3, salt: str = "ars") -> DataFrame:
    """qid, level, est at every level of all queries: for diagnoses."""
    one = rs_level(points, kernel, n, groups, salt)
    return reduce(DataFrame.unionByName, (one(x, queries).withColumn("level", F.lit(x.level)) for x in table))


def rs_diagnosed(points: DataFrame, kernel: Kernel, n: int, groups: int = 3, salt: str = "diag") -> LevelEstimate:
    """As rs_level(), but of groups * m draws a group, and exact where these are more than all rows."""
    from .exact import kde

    def estimate(x: Level, queries: DataFrame) -> DataFrame:
        if x.m * groups > n:
            return kde(points, queries, kernel).withColumnRenamed("density", "est")
        return rs_level(points, kernel, n, groups, salt)(replace(x, m=x.m * groups), queries)

    return estimate


def adaptive_rs(points: DataFrame, queries: DataFrame, kernel: Kernel, tau: float, eps: float, groups: int = 3, salt: str = "ars", skip: bool = True) -> DataFrame:
    """Adaptive uniform sampling; without skip, mean relaxation."""
    n = points.count()
    table = levels(tau, eps) if skip else relaxation_levels(tau, eps)
    return adaptive(queries, table, n, rs_level(points, kernel, n, groups, salt), lambda x: x.m * groups, skip=skip)


def adaptive_rs_diagnosed(points: DataFrame, queries: DataFrame, kernel: Kernel, tau: float, eps: float, groups: int = 3, salt: str = "diag") -> DataFrame:
    """As adaptive_rs(), by rs_diagnosed(): the levels that a diagnosis of estimators starts from."""
    n = points.count()
    return adaptive(queries, levels(tau, eps), n, rs_diagnosed(points, kernel, n, groups, salt), lambda x: n if x.m * groups > n else x.m * groups * groups)


def hbe_level(points: DataFrame, kernel: Kernel, d: int, groups: int, tables: int | None = None, subsample: int | None = None, seed: int = 11) -> LevelEstimate:
    """The median of `groups` means over tables of the level's own width and power, as many as it asks for or as are given."""

    def estimate(x: Level, queries: DataFrame) -> DataFrame:
        own = [hbe_uniform(points, queries, level_hashes(x, g, d, tables, seed), kernel, salt=f"ah{x.level}/{g}", subsample=subsample) for g in range(groups)]
        return reduce(DataFrame.unionByName, own).groupBy("qid").agg(F.median("est").alias("est"))

    return estimate


def adaptive_hbe(points: DataFrame, queries: DataFrame, kernel: Kernel, table: list[Level], d: int, groups: int = 3, tables: int | None = None, subsample: int | None = None, seed: int = 11, skip: bool = True) -> DataFrame:
    """Adaptive hashing; without skip, mean relaxation: levels follow one by one and only the estimate stops."""
    n = points.count()
    return adaptive(queries, table, n, hbe_level(points, kernel, d, groups, tables, subsample, seed), lambda x: (tables or x.m) * groups, skip=skip)


def level_hashes(x: Level, group: int, d: int, tables: int | None = None, seed: int = 11) -> Hashes:
    return Hashes.seeded(tables or x.m, x.k, d, x.w, seed + 1000 * x.level + group)


def above(estimates: DataFrame, queries: DataFrame, tau: float, column: str = "est") -> DataFrame:
    """The queries whose estimate, or exact density, reaches tau."""
    return queries.join(estimates.where(F.col(column) >= tau).select("qid"), "qid", "left_semi")


def drawn_above(queries: DataFrame, estimate: Callable[[DataFrame], DataFrame], tau: float, count: int, salt: str = "redraw") -> DataFrame:
    """`count` queries, or all there are, whose estimate reaches tau: queries are
    drawn in a seeded order, in blocks that double, and those below tau are drawn anew."""
    order = permuted(queries.select("qid", "q"), salt, "qid").persist()
    total, size = order.count(), 2 * count
    while True:
        block = order.where(F.col("row") < size)
        good = above(estimate(block.drop("row")), block, tau).where(F.col("row") < size)
        if size >= total or good.count() >= count:
            return good.orderBy("row").limit(count).select("qid", "q")
        size *= 2
