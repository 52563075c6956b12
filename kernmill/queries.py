"""Queries over the driver's tables, one for each operator, with their SQL.

Points are the rows of `embeddings` (64 dimensions), of `part` (2, as z-scores)
and of `lineitem` (4); queries are all points unless the operator samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .functions.kernels import Exponential, Gaussian, Kernel, Laplace, Matern, Polynomial, should_reject
from .functions.random import normal_sql, uniform, uniform_sql, uniform_value
from .functions.vector import scale, sqdist
from .operators import cells, cluster, diagnose, estimators, exact, gauss, generate, knn, lsh, metrics, order, sampling, sets, sweep, tree
from .operators.sweep import dealt, once
from .plans import config, planner
from .sources import matrices
from .storage import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------------ inputs
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, w, label, bw of the embeddings."""
    label = F.col("label")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (label + 1.0).alias("w"), (label * 0.5 + 1.0).alias("w2"), "label", (label * 0.05 + 0.5).alias("bw")
    )


def asked(points: DataFrame, *more) -> DataFrame:
    return points.select(F.col("id").alias("qid"), F.col("x").alias("q"), *more)


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x"), F.lit(1.0).alias("w"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, w of the parts, as z-scores."""
    return metrics.zscored(raw_parts(spark, sf_dir))


def at_places(raw: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `run` finds, a row a qid, at the z-scores of points (id, x, w) under all their weights. Copies of many
    points are put together before they are scaled, so `run` need not look for any, and the rows of a place are
    handed back to all of its points."""
    if raw.count() ** 2 < sweep.COPY_PAIRS or not (places := sweep.copied(raw, ["x"])):
        return run(metrics.zscored(raw).cache())
    there, _ = written(metrics.zscored(exact.together(raw, ["x"], ["w"]).withColumn("raw", F.col("x")), raw).select("id", "x", "w", "raw"), "places")
    found, one = run(there), F.struct("raw").alias("_q")
    if not sweep.few(raw, places):
        return sweep.once(asked(raw))[1](found)
    back = found.join(there.select(F.col("id").alias("qid"), one), "qid").drop("qid")
    return raw.select(F.col("id").alias("qid"), F.struct(F.col("x").alias("raw")).alias("_q")).join(F.broadcast(back), "_q").select(*found.columns)


P = """points as (select vec_id as id, embedding::double[] as x, (label + 1.0)::double as w, (label * 0.5 + 1.0)::double as w2, label, (label * 0.05 + 0.5)::double as bw from embeddings),
queries as (select id as qid, x as q, label as qlabel from points),
pairs as (select qid, q, id, x, w, w2, label, bw, qlabel, pow(list_distance(x, q), 2) as d2 from points, queries)"""
RAW_PART = "raw as (select p_partkey as id, p_size::double as a, p_retailprice::double as b from part)"
PART = f"""{RAW_PART},
points as (select id, [(a - avg(a) over ()) / stddev_pop(a) over (), (b - avg(b) over ()) / stddev_pop(b) over ()]::double[] as x from raw)"""
PART_PAIRS = f"{PART},\npairs as (select q.id as qid, p.id, pow(p.x[1] - q.x[1], 2) + pow(p.x[2] - q.x[2], 2) as d2 from points p, points q)"
H = 0.5
GAUSS, EXPO = Gaussian(H), Exponential(0.3)
D = 64


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ------------------------------------------------------------------ exact sums
@query(f"with {P} select qid, round(avg({GAUSS.sql('d2')}), 9) as density from pairs group by qid")
def exact_kde_gaussian(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(exact.kde(v, asked(v), GAUSS), "density")


@query(f"with {P} select qid, round(avg({EXPO.sql('d2')}), 9) as density from pairs group by qid")
def exact_kde_exponential(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(exact.kde(v, asked(v), EXPO), "density")


@query(f"with {P} select qid, round(avg({GAUSS.sql('d2')}), 9) as density from pairs group by qid")
def kde_column_path(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(exact.kde_columns(v, asked(v), GAUSS), "density")


@query(f"with {P} select qid, round(sum(w * {GAUSS.sql('d2')}), 8) as density from pairs group by qid")
def kde_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return exact.kernel_sums(v, asked(v), GAUSS, weights=["w"]).select("qid", F.round("sum", 8).alias("density"))


@query(f"""with {P} select qid, wset::int as wset, round(sum(case wset when 0 then w else w2 end * {GAUSS.sql("d2")}), 8) as g from pairs, range(2) t(wset) group by all""")
def kde_multiweight(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return exact.kernel_sums(v, asked(v), GAUSS, weights=["w", "w2"]).select("qid", "wset", F.round("sum", 8).alias("g"))


@query(f"with {P} select qid, round(sum(case when id <> qid then {EXPO.sql('d2')} else 0 end) / (select count(*) from points), 9) as density from pairs group by qid")
def kde_loo(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(exact.kde(v, asked(v), EXPO, loo=True), "density")


@query(f"with {P} select qid, label, round(avg({EXPO.sql('d2')}), 9) as density from pairs group by qid, label")
def kde_by_label(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return exact.kernel_sums(v, asked(v), EXPO, group="label").select("qid", "label", F.round(F.col("sum") / F.col("n"), 9).alias("density"))


@query(f"with {P} select qid, round(sum(case when d2 <= 1.69 then {EXPO.sql('d2')} else 0 end), 8) as g, count(*) filter (d2 <= 1.69) as n from pairs group by qid")
def kde_radius_cut(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return exact.kernel_sums(v, asked(v), EXPO, radius=1.3).select("qid", F.round("sum", 8).alias("g"), "n")


@query(f"with {P} select qid, round(sum({GAUSS.sql('d2')}), 8) as g, count(*) as n from pairs group by qid")
def kde_by_blocks(spark, sf_dir):
    """Three blocks of queries, each against every slice of the points, over a grid of cells."""
    v = vectors(spark, sf_dir)
    columns, schema, work = exact.summing(v, GAUSS)
    sums = dealt(v.select(*columns), asked(v), work, schema, 3, None)
    return sums.groupBy("qid").agg(F.round(F.sum("sum"), 8).alias("g"), F.sum("n").alias("n"))


def _of_kernel(name: str, kernel: Kernel, places: int = 8, columns: str = "embeddings") -> None:
    """A query for a kernel, over whole pairs of a table."""
    if columns == "embeddings":
        value = kernel.sql("list_dot_product(x, q)" if kernel.uses_dot else "d2")
        sql = f"with {P} select qid, round(avg({value}), {places}) as density from pairs group by qid"
        source = vectors
    elif columns == "first":
        sql = f"with {P}, short as (select qid, pow(x[1] - q[1], 2) + pow(x[2] - q[2], 2) + pow(x[3] - q[3], 2) as d2 from pairs) select qid, round(avg({kernel.sql('d2')}), {places}) as density from short group by qid"
        source = lambda s, d: vectors(s, d).withColumn("x", F.slice("x", 1, 3))
    else:
        sql = f"with {PART_PAIRS} select qid, round(avg({kernel.sql('d2')}), {places}) as density from pairs group by qid"
        source = lambda s, d: parts(s, d).cache()

    def run(spark, sf_dir):
        v = source(spark, sf_dir)
        return rounded(exact.kde(v, asked(v), kernel), "density", places=places)

    run.__name__ = name
    query(sql)(run)


_of_kernel("kernel_laplace_2d", Laplace(d=2), 7, "part")
_of_kernel("kernel_laplace_3d", Laplace(d=3), 6, "first")
_of_kernel("kernel_polynomial", Polynomial(h=1.0, c=1.0, p=3))
_of_kernel("kernel_matern_1_2", Matern(0.5, 0.5))
_of_kernel("kernel_matern_3_2", Matern(0.5, 1.5))
_of_kernel("kernel_matern_5_2", Matern(0.5, 2.5))
_of_kernel("kernel_matern_0_8", Matern(0.7, 0.8), 9)
_of_kernel("kernel_gaussian_half", Gaussian(0.4, half=True), 9, "part")


@query(f"with {P} select qid, round(avg({Gaussian(1.0, half=True).sql('(d2 / (bw * bw))')}), 9) as density from pairs group by qid")
def kernel_variable_bandwidth(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = exact.kernel_sums(v, asked(v), Gaussian(1.0, half=True), bandwidth="bw")
    return s.select("qid", F.round(F.col("sum") / F.col("n"), 9).alias("density"))


# ------------------------------------------------------- neighbours and ranges
KNN = "select qid, row_number() over (partition by qid order by d2, id)::int as rank, id, d2 from pairs"


@query(f"with {P} select qid, rank, id, round(d2, 8) as dist2 from ({KNN}) where rank <= 10")
def knn_self(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.knn(v, asked(v), 10).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


LATTICE = """points as (select p_partkey as id, [p_size::double, floor(p_retailprice / 20)::double] as x from part),
pairs as (select q.id as qid, p.id, pow(p.x[1] - q.x[1], 2) + pow(p.x[2] - q.x[2], 2) as d2 from points p, points q)"""


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x of the parts on whole numbers: exact distances with many ties."""
    x = F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 20).cast("double"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("x"))


@query(f"with {LATTICE} select qid, rank, id, d2 as dist2 from ({KNN}) where rank <= 4")
def knn_exact_2d(spark, sf_dir):
    """By the leaves of a k-d partition."""
    v = lattice(spark, sf_dir)
    return cells.knn(v, asked(v), 4)


@query(f"with {LATTICE} select qid, id, d2 as dist2 from pairs where d2 <= 4")
def range_join_cells(spark, sf_dir):
    v = lattice(spark, sf_dir)
    return cells.range_join(v, asked(v), 2.0)


@query(f"with {LATTICE} select qid, rank, id, d2 as dist2 from ({KNN}) where rank <= 6")
def knn_sweep_2d(spark, sf_dir):
    """All pairs."""
    v = lattice(spark, sf_dir)
    return knn.knn(v, asked(v), 6)




@query(f"with {P} select qid, round(sum(w * {GAUSS.sql('d2')}), 9) as potential from (select p.*, row_number() over (partition by qid order by d2, id) as rank from pairs p) where rank <= 10 group by qid")
def knn_kde(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(exact.neighbour_potential(knn.knn(v, asked(v), 10), v, GAUSS, "w"), "potential")


@query(f"with {P} select qid, id, round(d2, 8) as dist2 from pairs where d2 <= 1.44")
def range_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(knn.range_join(v, asked(v), 1.2), "dist2", places=8)


@query(f"with {P}, near as (select *, row_number() over (partition by qid order by d2, id) as rank from pairs where d2 <= pow(1.15 + qlabel * 0.01, 2)) select qid, id, round(d2, 8) as dist2 from near where rank <= 5")
def range_join_per_query(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = asked(v, (F.col("label") * 0.01 + 1.15).alias("radius"))
    return rounded(knn.range_join(v, q, "radius", most=5), "dist2", places=8)


@query(f"""with {P}, near as (select *, row_number() over (partition by qid order by d2, id) as rank from pairs), own as (select * from near where rank <= 4),
two as (select a.qid, b.id from own a join own b on b.qid = a.id union select qid, id from own),
best as (select t.qid, t.id, d2, row_number() over (partition by t.qid order by d2, t.id)::int as rank from two t join pairs using (qid, id))
select qid, rank, id, round(d2, 8) as dist2 from best where rank <= 6""")
def knn_refine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    own = knn.knn(v, asked(v), 4)
    return knn.refine(own, own, v, asked(v), 6).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


HASHES = lsh.Hashes.seeded(8, 4, D, 1.5, seed=3)
KEYS = f"points as (select vec_id as id, embedding::double[] as x, (label + 1.0)::double as w from embeddings), keyed as ({HASHES.sql('points')})"


@query(f"""with {P}, keyed as ({HASHES.sql("points")}), near as (select distinct a.id as qid, b.id from keyed a join keyed b using (tbl, key)),
best as (select qid, id, d2, row_number() over (partition by qid order by d2, id)::int as rank from near join pairs using (qid, id))
select qid, rank, id, round(d2, 8) as dist2 from best where rank <= 5""")
def approx_knn_lsh(spark, sf_dir):
    v = vectors(spark, sf_dir)
    keys = HASHES.keys(v)
    return knn.knn_by_keys(v, asked(v), keys, keys.withColumnRenamed("id", "qid"), 5).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


SINGLE = [lsh.Hashes.seeded(1, 3, D, 1.5, seed=60 + k) for k in range(4)]


@query(f"""with {P}, {", ".join(f"one{k} as ({h.sql('points')})" for k, h in enumerate(SINGLE))},
near as ({" union ".join(f"select a.id as qid, b.id from one{k} a join one{k} b using (key)" for k in range(len(SINGLE)))}),
best as (select qid, id, d2, row_number() over (partition by qid order by d2, id)::int as rank from near join pairs using (qid, id))
select qid, rank, id, round(d2, 8) as dist2 from best where rank <= 5""")
def approx_knn_to_target(spark, sf_dir):
    """Tables are added until an error is reached; one of zero takes all that there are."""
    v = vectors(spark, sf_dir)
    return knn.knn_lsh(v, asked(v), 5, SINGLE, 0.0).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


def _tree_sql(depth: int, salt: str, d: int = D) -> str:
    """Leaves of a space partition: a CTE for each level."""
    out, last = [], "select id, x, 1::bigint as leaf from points"
    for level in range(depth):
        t = f"list_dot_product(x, {cluster.projection(d, f'{salt}/{level}')}::double[])"
        out.append(f"{salt}{level} as (select id, x, leaf * 2 + (t > median(t) over (partition by leaf))::bigint as leaf from (select *, {t} as t from ({last})))")
        last = f"select * from {salt}{level}"
    return ", ".join(out) + f", {salt} as ({last})"


TREES = ("ta", "tb", "tc", "td")


@query(f"""with {P}, {", ".join(_tree_sql(3, t) for t in TREES)},
near as ({" union ".join(f"select a.id as qid, b.id from {t} a join {t} b using (leaf)" for t in TREES)}),
best as (select qid, id, d2, row_number() over (partition by qid order by d2, id)::int as rank from near join pairs using (qid, id))
select qid, rank, id, round(d2, 8) as dist2 from best where rank <= 5""")
def approx_knn_forest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    keys = None
    for k, t in enumerate(TREES):
        own = cluster.space_partition(v, 3, D, t).select("id", F.lit(k).alias("tbl"), F.col("leaf").cast("string").alias("key"))
        keys = own if keys is None else keys.unionByName(own)
    return knn.knn_by_keys(v, asked(v), keys, keys.withColumnRenamed("id", "qid"), 5).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


SAMPLED = (24, 3, "rl")


@query(f"""with {P}, rep as (select id from points order by {uniform_sql("id", "'rl'")}, id limit {SAMPLED[0]}), away as (select qid as id, pairs.id as rep, d2 from pairs join rep using (id)),
leaf as (select id, arg_min(rep, [d2, rep]) as leaf from away group by id),
asked as (select distinct qid, leaf from (select id as qid, r, arg_min(rep, [case when r = 0 then d2 else -ln({uniform_sql("id || '/' || rep || '/' || r", "'rl'")}) * d2 end, rep]) as leaf from away, range({SAMPLED[1] + 1}) t(r) group by id, r)),
near as (select a.qid, l.id from asked a join leaf l using (leaf)), best as (select qid, id, d2, row_number() over (partition by qid order by d2, id)::int as rank from near join pairs using (qid, id))
select qid, rank, id, round(d2, 8) as dist2 from best where rank <= 5""")
def approx_knn_sampled(spark, sf_dir):
    """Leaves around sampled points, of which a query searches its own and some drawn ones."""
    v = vectors(spark, sf_dir)
    return knn.knn_sampled(v, asked(v), 5, *SAMPLED).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


@query(f"""with {P}, best as (select qid, id, d2, row_number() over (partition by qid order by d2, id)::int as rank from pairs) select qid, rank, id, round(d2, 8) as dist2 from best where rank <= 3""")
def knn_by_blocks(spark, sf_dir):
    v = vectors(spark, sf_dir)
    lists = dealt(v.select("id", "x"), asked(v), knn.nearest(3), "qid long, dist2 double, id long", 3, None)
    return knn.merge(lists, 3).select("qid", "rank", "id", F.round("dist2", 8).alias("dist2"))


@query(f"""with {P}, keyed as ({HASHES.sql("points")}), near as (select distinct a.id as qid, b.id from keyed a join keyed b using (tbl, key)),
found as (select * from (select qid, id, d2, row_number() over (partition by qid order by d2, id) as rank from near join pairs using (qid, id)) where rank <= 5),
truth as (select * from ({KNN}) where rank <= 5)
select (select round(avg((f.id is not null)::int), 9) from truth t left join found f using (qid, id)) as hit_rate,
(select count(*) from truth t left join found f using (qid, id) where f.id is null) as missed,
(select round(avg((sqrt(f.d2) - sqrt(t.d2)) / sqrt(t.d2)), 7) from truth t join found f using (qid, rank) where t.d2 > 1e-12) as mean_error""")
def knn_quality(spark, sf_dir):
    v = vectors(spark, sf_dir)
    keys = HASHES.keys(v)
    found = knn.knn_by_keys(v, asked(v), keys, keys.withColumnRenamed("id", "qid"), 5)
    q = knn.quality(knn.knn(v, asked(v), 5), found)
    return q.select(F.round("hit_rate", 9).alias("hit_rate"), "missed", F.round("mean_error", 7).alias("mean_error"))


@query(f"with {PART_PAIRS} select qid, count(*) as n from pairs where d2 <= 0.01 group by qid")
def range_tree_count(spark, sf_dir):
    """Points counted in the leaves of a tree of random projections that each query's ball meets, copies together."""
    v = parts(spark, sf_dir).cache()
    depth = 6
    cuts = cluster.partition_cuts(v, depth, 2, "rt")
    leaves = cluster.space_partition(exact.together(v, ["x"]), depth, 2, "rt", keep=("id", "x", "_n"), cuts=cuts)
    some, back = once(asked(v))
    there = cluster.routed(some, cuts, "rt", reach=0.1 + 1e-9).join(some, "qid").select(F.col("leaf").alias("cell"), "qid", "q")
    return back(cells.range_count(leaves.select(F.col("leaf").alias("cell"), "id", "x", "_n"), there, 0.1))


# ----------------------------------------------------------------- statistics
LONG = "long as (select id, generate_subscripts(x, 1)::int - 1 as j, unnest(x) as v from points)"


@query(f"with {P}, {LONG} select j, count(*) as n, round(avg(v), 9) as mean, round(min(v), 9) as low, round(max(v), 9) as high, round(stddev_pop(v), 9) as sd, round(var_samp(v), 9) as var, round(stddev_pop(v) / sqrt(count(*)), 9) as se from long group by j")
def column_stats(spark, sf_dir):
    return rounded(metrics.column_stats(vectors(spark, sf_dir)), "mean", "low", "high", "sd", "var", "se")


@query(f"with {PART} select id, round(x[1], 8) as a, round(x[2], 8) as b from points")
def zscore_points(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.round(F.col("x")[0], 8).alias("a"), F.round(F.col("x")[1], 8).alias("b"))


@query(f"with {RAW_PART} select id, round((a - min(a) over ()) / (max(a) over () - min(a) over ()), 8) as a, round((b - min(b) over ()) / (max(b) over () - min(b) over ()), 8) as b from raw")
def unit_cube(spark, sf_dir):
    raw = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x"))
    return metrics.unit_cube(raw).select("id", F.round(F.col("x")[0], 8).alias("a"), F.round(F.col("x")[1], 8).alias("b"))


@query(f"with {P}, {LONG} select label, j, round(avg(v), 9) as m from long join points using (id) group by label, j")
def centroid_by_label(spark, sf_dir):
    m = cluster.means(vectors(spark, sf_dir), "label")
    return m.select("label", F.posexplode("center").alias("j", "m")).withColumn("m", F.round("m", 9))


@query(f"with {PART} select round(least(2 * sqrt(max(x[1] * x[1] + x[2] * x[2])), ln(count(*) / 0.001)), 8) as diameter from points")
def diameter(spark, sf_dir):
    return rounded(cluster.diameter(parts(spark, sf_dir), 0.001), "diameter", places=8)


@query("select round(quantile_cont(l_quantity, 0.5), 6) as q, round(quantile_cont(l_extendedprice, 0.5), 6) as p, round(quantile_cont(l_discount, 0.25), 6) as d from lineitem")
def column_quantiles(spark, sf_dir):
    q = metrics.quantiles(read(spark, sf_dir, "lineitem"), {"l_quantity": 0.5, "l_extendedprice": 0.5, "l_discount": 0.25})
    return q.select(F.round("l_quantity", 6).alias("q"), F.round("l_extendedprice", 6).alias("p"), F.round("l_discount", 6).alias("d"))


@query(f"with {PART} select id, (t > median(t) over ())::int as side from (select id, 0.6::double * x[1] + 0.8::double * x[2] as t from points)")
def equal_halves(spark, sf_dir):
    return cluster.equal_halves(parts(spark, sf_dir), [0.6, 0.8])


@query(f"with {P}, {_tree_sql(4, 'sp')} select leaf, count(*) as n, min(id) as low from sp group by leaf")
def space_partition(spark, sf_dir):
    return cluster.space_partition(vectors(spark, sf_dir), 4, D, "sp").groupBy("leaf").agg(F.count("*").alias("n"), F.min("id").alias("low"))


def _variance_sql(depth: int) -> str:
    out = ["v0 as (select id, x, 1::bigint as leaf from points)"]
    for n in range(depth):
        out.append(f"j{n} as (select leaf, arg_max(j, [s, -j]) as j from (select leaf, j, var_pop(v) as s from (select leaf, generate_subscripts(x, 1) as j, unnest(x) as v from v{n}) group by leaf, j) group by leaf)")
        out.append(f"v{n + 1} as (select id, x, leaf * 2 + (t > median(t) over (partition by leaf))::bigint as leaf from (select id, x, leaf, x[j] as t from v{n} join j{n} using (leaf)))")
    return ", ".join(out)


@query(f"with {P}, {_variance_sql(3)} select leaf, count(*) as n, min(id) as low from v3 group by leaf")
def space_partition_variance(spark, sf_dir):
    return cluster.variance_partition(vectors(spark, sf_dir), 3).groupBy("leaf").agg(F.count("*").alias("n"), F.min("id").alias("low"))


# ------------------------------------------------------------ scalar formulas
def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(1, 201).select("id", (F.col("id") * 0.02).alias("c"))


GRID = "grid as (select id, id * 0.02::double as c from range(1, 201) t(id))"


@query(f"with {GRID} select id, round({scalar.erf_sql('c')}, 10) as erf, round({scalar.collision_sql('c', '1.0', '3.0')}, 10) as p, round({scalar.collision_sql('c', '1.0', '3.0', True)}, 10) as p_exact, round({scalar.collision_sql('c', '5.0', '3.0', False, 1e-2)}, 10) as p_near from grid")
def collision_grid(spark, sf_dir):
    c = F.col("c")
    return _grid(spark).select("id", F.round(scalar.erf(c), 10).alias("erf"), F.round(scalar.collision(c, 1.0, F.lit(3.0)), 10).alias("p"), F.round(scalar.collision(c, 1.0, F.lit(3.0), exact=True), 10).alias("p_exact"), F.round(scalar.collision(c, 5.0, F.lit(3.0), near=1e-2), 10).alias("p_near"))


MUS = [k * 0.004 for k in range(1, 249)]


@query(f"""with mu as (select id, id * 0.004::double as mu from range(1, 249) t(id)) select id, round(0.5 * sqrt(-ln(mu)), 10) as inv_gauss, round(-0.3 * ln(mu), 10) as inv_exp, round(exp(1.854::double) / sqrt(mu), 8) as rv_gauss,
round(exp(1.5::double) / sqrt(mu), 8) as rv_exp, round(4 * exp(1.5::double) * pow(mu, -0.75::double), 8) as rvd_gauss, round(pow(mu, -0.75::double), 8) as rvd_exp from mu""")
def kernel_bounds(spark, sf_dir):
    """The library's inverses and variance bounds, of which the planner's levels are made."""
    rows = [(k, *(round(v, 10) for v in (GAUSS.inverse(mu), EXPO.inverse(mu))), *(round(v, 8) for v in (GAUSS.relative_variance(mu), EXPO.relative_variance(mu), GAUSS.relative_variance(mu, 0.75), EXPO.relative_variance(mu, 0.75)))) for k, mu in enumerate(MUS, 1)]
    return spark.createDataFrame(rows, "id long, inv_gauss double, inv_exp double, rv_gauss double, rv_exp double, rvd_gauss double, rvd_exp double")


@query(f"""with {P} select (select round(sqrt(2.0::double) * pow(count(*), -1.0::double / 68) , 10) from points) as scott, round(-32 * ln(2 * pi()), 9) as gauss, round(-ln(2.0::double) - 32 * ln(pi()) + lgamma(32.0::double) - lgamma(64.0::double), 9) as expo,
round(sqrt(sum(pow(x[1] / 2, 2))), 9) as first from points""")
def scale_factors(spark, sf_dir):
    """Scott's factor, the logarithms of the kernels' dimension factors, and points scaled by a bandwidth."""
    v = vectors(spark, sf_dir)
    scaled = v.select(scale(F.col("x"), 2.0).alias("x")).agg(F.round(F.sqrt(F.sum(F.col("x")[0] * F.col("x")[0])), 9).alias("first"))
    made = (math.sqrt(2.0) * scalar.scott(v.count(), D), GAUSS.dimension_factor(D), EXPO.dimension_factor(D))
    return scaled.select(F.lit(round(made[0], 10)).alias("scott"), F.lit(round(math.log(made[1]), 9)).alias("gauss"), F.lit(round(math.log(made[2]), 9)).alias("expo"), "first")


@query("""select id, least(3 * ceil(pow(0.5 * d, 2)), ceil(0.5 * d * sqrt(pi() / 2)))::int as k, ceil(sqrt(2 * pi()) * 0.5 * ln(1 / (id * 0.01::double)))::int as of_density, ceil(0.5 * sqrt(pi() / 2) * d)::int as of_width,
round(5 / (0.5 * sqrt(pi() / 2)), 10) as width from (select id, id * 0.13::double as d from range(1, 100) t(id))""")
def hash_parameters(spark, sf_dir):
    rows = [(k, scalar.hash_power(k * 0.13), scalar.hash_power_of_density(k * 0.01), scalar.hash_power_of_width(k * 0.13), round(scalar.hash_width(5), 10)) for k in range(1, 100)]
    return spark.createDataFrame(rows, "id long, k int, of_density int, of_width int, width double")


@query(f"""with {GRID} select id, least(9, ceil(ln(mu * exp(2 / pi())) / ln(0.25::double))::int)::int as g, least(9, ceil(ln(mu) / ln(0.25::double))::int)::int as e,
(ln(0.4::double) + ln(0.3::double) - 2 * ln(mu)) / ln(0.01::double) - 1 < -0.5 as r, (ln(0.4::double) + ln(0.3::double) - 2 * ln(mu)) / ln(0.01::double) - 1 < ln(4 * exp(1.5::double)) / ln(0.01::double) - 0.5 as rg
from (select id, c / 5 as mu from grid where c < 5)""")
def kernel_levels(spark, sf_dir):
    mu = F.col("c") / 5
    reject = lambda k: should_reject(k, F.lit(0.4), mu, F.lit(0.3), 0.01, 0.5)
    return _grid(spark).where("c < 5").select("id", Gaussian().find_level(mu, 9, 1.0).alias("g"), Exponential().find_level(mu, 9).alias("e"), reject(Exponential()).alias("r"), reject(Gaussian()).alias("rg"))


def _level_rows(table: list[estimators.Level]) -> str:
    return "values " + ", ".join(f"({x.level}, {x.mu!r}::double, {x.m})" for x in table)


TAU, EPS = 1 / 64, 0.5


@query("select i::int as level, pow(2.0::double, -(i + 1)) as mu, ceil(pow(2.0::double, i + 1) / 0.25)::int as m from range(6) t(i)")
def level_table_rs(spark, sf_dir):
    return estimators.level_frame(spark, estimators.levels(TAU, EPS)).select("level", F.col("mu").cast("double").alias("mu"), "m")


@query("""with l as (select i::int as level, pow(2.0::double, -(i + 1)) as mu, sqrt(ln(64::double)) as r from range(6) t(i)), t as (select *, sqrt(ln(1 / mu)) as t from l), k as (select *, 3 * ceil(r * t)::int as k from t)
select level, mu, ceil(exp(1.854::double) / sqrt(mu) / 0.25)::int as m, round(t, 9) as t, k::int as k, round(k / t * sqrt(2 / pi()), 9) as w from k""")
def level_table_hbe(spark, sf_dir):
    return rounded(estimators.level_frame(spark, estimators.levels(TAU, EPS, Gaussian())), "t", "w").withColumn("mu", F.col("mu").cast("double"))


@query("""with l as (select i::int as level, pow(2.0::double, -(i + 1)) as mu, ln(64::double) as d from range(6) t(i)), k as (select *, least(3 * ceil(pow(0.5 * d, 2)), ceil(0.5 * d * sqrt(pi() / 2)))::int as k from l)
select level, mu, ceil(exp(1.5::double) / sqrt(mu) / 0.25)::int as m, k, round(k / (0.5 * sqrt(pi() / 2)), 9) as w from k""")
def level_table_exponential(spark, sf_dir):
    table = estimators.levels(TAU, EPS, Exponential(), diameter=math.log(64))
    return rounded(estimators.level_frame(spark, table).select("level", F.col("mu").cast("double").alias("mu"), "m", "k", "w"), "w")


PLANS = [(n, k) for n in (1000, 100000, 10000000) for k in (10, 50)]
RATES = planner.Rates()
_SECONDS = f"(differences * {RATES.differences!r} + kernels * {RATES.kernels!r} + products * {RATES.products!r} + moved * {RATES.moved!r}) / 8 + jobs * {RATES.jobs!r}"


@query(f"""with g as (select n::double as n, k::double as k, 1000::double as m, 3::double as d, 2::double as w from (values (1000), (100000), (10000000)) a(n), (values (10), (50)) b(k)),
works as (select n, k, 'sweep' as way, n * m * d as differences, n * m as kernels, n * m * w as products, 16 * m * w * 28 as moved, 2::double as jobs from g
union all select n, k, 'cells', 64 * m * d + (n + m) * 7 * d, 64 * m, 64 * m * w, 8 * n * (d + w + 2) + 4 * m * (8 * (d + 2) + w * 28), 10 from g
union all select n, k, 'series', (n * k * (k + 1) / 2 + m * k) * d, n + m * 3, (n + m * 3) * 20 * (1 + w), 8 * 16 * k * w * 20, k + 4 from g)
select n::bigint as n, k::int as k, way, round({_SECONDS}, 6) as seconds from works""")
def plan_costs(spark, sf_dir):
    """Estimates of the three ways for 1,000 queries in three dimensions with two weight sets."""
    rows = []
    for n, k in PLANS:
        works = {"sweep": planner.by_sweep(n, 1000, 3, 2, 16), "cells": planner.by_cells(n, 1000, 3, 2, 64, 4, 7), "series": planner.by_series(n, 1000, 3, 2, k, 20, 3, 16)}
        rows += [f"({n}L, {k}, '{name}', {planner.seconds(w, RATES)!r}D)" for name, w in works.items()]
    return spark.sql("select n, k, way, round(seconds, 6) as seconds from values " + ", ".join(rows) + " as t(n, k, way, seconds)")


@query()
def choose_method(spark, sf_dir):
    v = parts(spark, sf_dir).cache()
    found = planner.choose_method(v, asked(v), 0.1, 1e-2)
    return spark.sql("select '{method}' as method, {order} as p, {clusters} as k, {sweep!r}D as sweep, {cells!r}D as cells, {series!r}D as series".format(**found))


# -------------------------------------------------------------------- hashing
@query(f"with {KEYS} select id, tbl, key from keyed")
def lsh_keys(spark, sf_dir):
    return HASHES.keys(vectors(spark, sf_dir))


def _race(weight: str = "1.0::double", salt: str = "rep") -> str:
    u = uniform_sql("id || '/' || tbl", f"'{salt}'")
    return f"arg_min(id, -ln({u}) / {weight})"


@query(f"with {KEYS} select tbl, key, count(*) as cnt, count(*)::double as wsum, {_race()} as rep_id from keyed group by tbl, key")
def lsh_buckets(spark, sf_dir):
    return lsh.buckets(HASHES.keys(vectors(spark, sf_dir)))


@query(f"with {KEYS} select tbl, key, count(*) as cnt, sum(w) as wsum, {_race('w')} as rep_id from keyed join points using (id) group by tbl, key")
def lsh_buckets_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return lsh.buckets(HASHES.keys(v).join(v.select("id", "w"), "id"), "w")


STEP = lsh.scale_step(1.0, 10.0, 3)
SCALE_SQL = f"floor(ln(w / 1.0::double) / ln({STEP!r}::double))::int"


@query(f"with {KEYS} select tbl, key, {SCALE_SQL} as scale, count(*) as cnt, sum(w) as wsum, {_race('w')} as rep_id from keyed join points using (id) group by all")
def lsh_buckets_scales(spark, sf_dir):
    v = vectors(spark, sf_dir)
    keyed = HASHES.keys(v).join(v.select("id", "w", lsh.scale_index(F.col("w"), 1.0, STEP).alias("scale")), "id")
    return lsh.buckets(keyed, "w", "scale")


FLOOR_A = np.random.default_rng(9).standard_normal((3, D)).round(6)
FLOOR_B = np.array([0.25, 0.5, 0.75])
FLOOR_M = np.array([7919, 104729, 1299709])


@query("with points as (select vec_id as id, embedding::double[] as x from embeddings) select id, (((" + " + ".join(f"{int(m)} * floor(list_dot_product(x, {a.tolist()}::double[]) / 2.0::double + {b!r}::double)::bigint" for a, b, m in zip(FLOOR_A, FLOOR_B.tolist(), FLOOR_M, strict=True)) + ") % 4294967291) + 4294967291) % 4294967291 as key from points")
def lsh_floor_keys(spark, sf_dir):
    return lsh.floor_keys(vectors(spark, sf_dir), FLOOR_A, FLOOR_B.tolist(), 0.5, FLOOR_M)


COLLIDE = scalar.collision_sql("sqrt(d2)", repr(HASHES.width), "4.0")


def _probe_sql(mass: str, weight: str, group: str = "") -> str:
    """Estimates of a hashed table: buckets, a representative, the probe of all queries."""
    return f"""with {P}, keyed as ({HASHES.sql("points")}),
table_ as (select tbl, key, {mass} as mass, {_race(weight)} as id from keyed join points using (id) group by tbl, key{group}),
met as (select k.id as qid, k.tbl, t.mass, t.id from keyed k left join table_ t using (tbl, key)),
z as (select qid, sum({GAUSS.sql("d2")} / {COLLIDE} * mass) as z from met join pairs using (qid, id) group by qid)
select qid, round(coalesce(z, 0) / 8, 8) as est from queries left join z using (qid)"""


@query(_probe_sql("count(*) / (select count(*) from points)::double", "1.0::double"))
def hbe_uniform(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.hbe_uniform(v, asked(v), HASHES, GAUSS), "est", places=8)


@query(_probe_sql("sum(w) / (select count(*) from points)::double", "w"))
def hbe_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.hbe_weighted(v, asked(v), HASHES, GAUSS, "w"), "est", places=8)


@query(_probe_sql("sum(w) / (select count(*) from points)::double", "w", f", {SCALE_SQL}"))
def hbe_scales(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.hbe_weighted(v, asked(v), HASHES, GAUSS, "w", lsh.scale_index(F.col("w"), 1.0, STEP)), "est", places=8)


BLOCK_ROWS = 120


def _block_sql(n_sql: str = "(select count(*) from points)") -> str:
    starts = ", ".join(f"({t}, floor({uniform_value(t, 'rep-block')!r}::double * ({n_sql} - {BLOCK_ROWS})))" for t in range(8))
    return f"""with {P}, perm as (select id, row_number() over (order by {uniform_sql("id", "'rep-perm'")}, id) - 1 as row from points), begins as (select * from (values {starts}) as b(tbl, s)),
keyed0 as ({HASHES.sql("points")}), keyed1 as (select k.* from keyed0 k join perm using (id) join begins using (tbl) where row >= s and row < s + {BLOCK_ROWS}),
table_ as (select tbl, key, count(*) / {BLOCK_ROWS}::double as mass, {_race()} as id from keyed1 group by tbl, key),
met as (select k.id as qid, k.tbl, t.mass, t.id from keyed0 k left join table_ t using (tbl, key)),
z as (select qid, sum({GAUSS.sql("d2")} / {COLLIDE} * mass) as z from met join pairs using (qid, id) group by qid)
select qid, round(coalesce(z, 0) / 8, 8) as est from queries left join z using (qid)"""


@query(_block_sql())
def hbe_subsampled(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.hbe_uniform(v, asked(v), HASHES, GAUSS, subsample=BLOCK_ROWS), "est", places=8)


# ------------------------------------------------------------------- sampling
def _rows(n: str = "points") -> str:
    return f"rows_ as (select id, x, row_number() over (order by id) - 1 as row from {n}), total as (select count(*) as n from {n})"


def _draws_sql(m: int, salt: str) -> str:
    u = uniform_sql("qid || '/' || r", f"'{salt}'")
    return f"select qid, r, least(floor({u} * n)::bigint, n - 1) as row from queries, range({m}) t(r), total"


@query(f"with {P}, {_rows()}, drawn as ({_draws_sql(64, 'rs')}) select qid, round(avg({GAUSS.sql('d2')}), 9) as est from drawn join rows_ using (row) join pairs using (qid, id) group by qid")
def rs_estimate(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.random_sampling(v, asked(v), GAUSS, 64), "est")


@query(f"""with {P}, res as (select * from points order by {uniform_sql("id", "'rs-reservoir'")}, id limit 100), {_rows("res")}, drawn as ({_draws_sql(40, "rs")})
select qid, round(avg({GAUSS.sql("d2")}), 9) as est from drawn join rows_ using (row) join pairs using (qid, id) group by qid""")
def rs_reservoir(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.random_sampling(v, asked(v), GAUSS, 40, reservoir=100), "est")


@query(f"select o_orderkey as id from orders order by {uniform_sql('o_orderkey', chr(39) + 'pick' + chr(39))}, o_orderkey limit 50")
def sample_pick_set(spark, sf_dir):
    return sampling.pick_set(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 50, "pick")


@query(f"select id, row from (select c_custkey as id, row_number() over (order by {uniform_sql('c_custkey', chr(39) + 'perm' + chr(39))}, c_custkey) - 1 as row from customer)")
def sample_permutation(spark, sf_dir):
    return sampling.permuted(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "perm").select("id", "row")


@query(f"""with w as (select s_suppkey as id, greatest(s_acctbal::double, 0) + 1 as w from supplier), c as (select *, sum(w) over (order by id) as hi, sum(w) over () as t from w),
u as (select r, {uniform_sql("r", "'wd'")} as u from range(200) t(r)) select r::bigint as r, id from u, c where u * t >= hi - w and u * t < hi""")
def sample_weighted(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.greatest(F.col("s_acctbal").cast("double"), F.lit(0.0)) + 1).alias("w"))
    return sampling.weighted_draws(s, "w", 200, "wd")


@query("select o_orderkey as id, row_number() over (order by o_totalprice, o_orderkey) - 1 as row, round(sum(o_totalprice) over (order by o_totalprice, o_orderkey rows unbounded preceding) - o_totalprice, 2) as before from orders")
def prefix_sums(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("p"))
    both = order.prefix_sum(order.dense_index(o, ["p", "id"]), ["p", "id"], F.col("p"))
    return both.select("id", "row", F.round("before", 2).alias("before"))


# -------------------------------------------------------------------- sketches
SKETCH = [lsh.Hashes.seeded(1, 4, D, 1.5, seed=20 + k) for k in range(5)]
GAMMA = "(case when count(*) > 890.9 or max(size) <= 0.001 * sum(size) then 1.0 else 1.0 - ln(1.1::double) / ln(max(size) / (0.001 * sum(size))) end)"


@query(f"""with points as (select vec_id as id, embedding::double[] as x from embeddings), keyed as ({SKETCH[0].sql("points")}), sizes as (select key, count(*) as size from keyed group by key),
g as (select {GAMMA}::double as g, sum(size) as n from sizes), t as (select sum(pow(size::double, g)) as t from sizes, g)
select id, size, round(pow(size::double, g) / t / size, 10) as prob, round(1 / (pow(size::double, g) / t / size * n), 8) as weight from keyed join sizes using (key), g, t""")
def sketch_members(spark, sf_dir):
    return estimators.sketch_members(vectors(spark, sf_dir), SKETCH[0]).select("id", "size", F.round("prob", 10).alias("prob"), F.round("weight", 8).alias("weight"))


def _members_sql(hashes: lsh.Hashes, p: str, source: str = "points") -> str:
    """Members of a sketch, as CTEs; the last, c, with running sums of probabilities."""
    prob = f"pow(size::double, g) / t / size"
    return f"""k{p} as ({hashes.sql(source)}), s{p} as (select key, count(*) as size from k{p} group by key), g{p} as (select {GAMMA}::double as g, sum(size) as n from s{p}), t{p} as (select sum(pow(size::double, g)) as t from s{p}, g{p}),
m{p} as (select id, {prob} as prob, 1 / ({prob} * n) as weight from k{p} join s{p} using (key), g{p}, t{p}), c{p} as (select *, sum(prob) over (order by id) as hi, sum(prob) over () as tot from m{p})"""


def _drawn_sql(p: str, m: int, salt: str) -> str:
    return f"select r, id, weight from c{p}, (select r, {uniform_sql('r', chr(39) + salt + chr(39))} as u from range({m}) t(r)) where u * tot >= hi - prob and u * tot < hi"


def _hbs_sql(tables: list[lsh.Hashes], m: int, salt: str, p: str) -> tuple[str, str]:
    """CTEs, and (id, weight) of the draws of all tables."""
    ctes, draws = [], []
    for k, h in enumerate(tables):
        own, source = m // len(tables) + (m % len(tables) if k == 0 else 0), "points"
        if len(tables) > 2:
            source = f"r{p}{k}"
            ctes.append(f"{source} as (select * from points order by {uniform_sql('id', chr(39) + f'{salt}{k}-rows' + chr(39))}, id limit (select 2 * count(*) // {len(tables)} from points))")
        ctes.append(_members_sql(h, f"{p}{k}", source))
        draws.append(f"select id, weight / {m} as w from ({_drawn_sql(f'{p}{k}', own, f'{salt}{k}')})")
    return ", ".join(ctes), " union all ".join(draws)


def _evaluated(draws: str) -> str:
    return f"select qid, sum(e.w * {EXPO.sql('d2')}) as est from ({draws}) e join pairs using (id) group by qid"


_HBS = _hbs_sql(SKETCH, 100, "hbs", "h")


@query(f"with {P}, {_HBS[0]} select qid, round(est, 9) as est from ({_evaluated(_HBS[1])})")
def hbs_sketch(spark, sf_dir):
    v = vectors(spark, sf_dir)
    sketch = estimators.hbs_sketch(v, SKETCH, 100)
    return rounded(estimators.evaluate_sketch(sketch, v, asked(v), EXPO), "est")


def _hbe_sketch_sql(scales: int | None) -> str:
    """Tables over weighted draws from two sketches in turn, with or without scales."""
    draws = " union all ".join(f"select id, {t} as tbl, weight from ({_drawn_sql(str(t % 2), 22, f'hs{t}')})" for t in range(8))
    step = f"(pow(high / low, 1.0::double / {scales}) * 1.1)"
    scale_, by = (f"floor(ln(one / low) / ln({step}))::int", ", scale") if scales else ("0", "")
    return f"""with {P}, {_members_sql(SKETCH[0], "0")}, {_members_sql(SKETCH[1], "1")}, keyed as ({HASHES.sql("points")}),
each as (select id, tbl::int as tbl, sum(weight) as w, max(weight) as one from ({draws}) group by all), ends as (select min(one) as low, max(one) as high from each),
table_ as (select tbl, key{by}, sum(w) / 22 as mass, {_race("w", "hs")} as id from (select e.*, {scale_} as scale, key from each e join keyed using (id, tbl), ends) group by tbl, key{by}),
met as (select k.id as qid, k.tbl, t.mass, t.id from keyed k left join table_ t using (tbl, key)),
z as (select qid, sum({EXPO.sql("d2")} / {COLLIDE} * mass) as z from met join pairs using (qid, id) group by qid)
select qid, round(coalesce(z, 0) / 8, 8) as est from queries left join z using (qid)"""


@query(_hbe_sketch_sql(None))
def hbe_sketch(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.hbe_sketch(v, asked(v), HASHES, SKETCH[:2], EXPO, 22), "est", places=8)


@query(_hbe_sketch_sql(3))
def hbe_sketch_scales(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.hbe_sketch(v, asked(v), HASHES, SKETCH[:2], EXPO, 22, scales=3), "est", places=8)


@query(_hbe_sketch_sql(None))
def hbe_sketch_given(spark, sf_dir):
    """Sketches that are given as rows, by their ids."""
    v = vectors(spark, sf_dir)
    given = [estimators.sketch_members(v, h) for h in SKETCH[:2]]
    return rounded(estimators.hbe_sketch(v, asked(v), HASHES, given, EXPO, 22), "est", places=8)


_MEDIAN = [_hbs_sql([h], 50, f"s{k}", f"d{k}") for k, h in enumerate(SKETCH)]


@query(f"with {P}, {', '.join(c for c, _ in _MEDIAN)} select qid, round(median(est), 9) as est from ({' union all '.join(_evaluated(d) for _, d in _MEDIAN)}) group by qid")
def sketch_median(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.median_of_sketches([estimators.hbs_sketch(v, [h], 50, f"s{k}") for k, h in enumerate(SKETCH)], v, asked(v), EXPO), "est")


def _weights(spark: SparkSession, rows: list[tuple[int, float]]) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"({i}L, {w!r}D)" for i, w in rows) + " as t(id, weight)")


def _sample_sql(name: str, n: int, salt: str) -> str:
    return f"{name} as materialized (select id, x from points order by {uniform_sql('id', chr(39) + salt + chr(39))}, id limit {n})"


def _herding_sql(n: int, m: int) -> str:
    """Greedy picks by a fixed unroll: g<t> the running kernel sums, p<t> the pick."""
    k = EXPO.sql("pow(list_distance(a.x, b.x), 2)")
    ctes = [_sample_sql("s", n, "herd"), f"kk as materialized (select a.id as i, b.id as j, {k} as k from s a, s b)", "dens as materialized (select i as id, avg(k) as density from kk group by i)", "g0 as materialized (select id, 0.0::double as run from dens)"]
    for t in range(m):
        ctes.append(f"p{t} as materialized (select id from g{t} join dens using (id) order by round(density - run / {t + 1}, 12) desc, id limit 1)")
        ctes.append(f"g{t + 1} as materialized (select g.id, run + k as run from g{t} g join kk on kk.i = g.id join p{t} on kk.j = p{t}.id)")
    return ", ".join(ctes) + ", picks as (" + " union all ".join(f"select id from p{t}" for t in range(m)) + ")"


@query(f"with {P}, {_herding_sql(256, 40)} select qid, round(est, 9) as est from ({_evaluated('select id, 1.0::double / 40 as w from picks')})")
def herding(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.evaluate_sketch(_weights(spark, gauss.herding(v, EXPO, 256, 40)), v, asked(v), EXPO), "est")


def _ska_sql(n: int, k: int, centers: int) -> str:
    d2 = "pow(list_distance(p.x, s.x), 2)"
    ctes = [_sample_sql("smp", n, "ska"), "c0 as materialized (select 0 as n, id, x from smp order by id limit 1)"]
    for i in range(1, centers):
        ctes.append(f"c{i} as materialized (select * from c{i - 1} union all (select {i}, p.id, any_value(p.x) from smp p, c{i - 1} s group by p.id order by round(min({d2}), 12) desc, p.id limit 1))")
    u = uniform_sql("id", "'ska-rest'")
    ctes.append(f"rest as (select id from smp where id not in (select id from c{centers - 1}) order by {u}, id limit {k - centers})")
    return ", ".join(ctes) + f" select id, true as center, 0.0::double as value from c{centers - 1} union all select id, false, round((1 - 1.0::double / {centers}) / {k - centers}, 9) from rest"


@query(f"with {P}, {_ska_sql(256, 30, 6)}")
def ska_sketch(spark, sf_dir):
    """Of the centers by how much their weighted kernel sums miss the sample's means, which is nothing; of the rest the weights."""
    v = vectors(spark, sf_dir)
    rows = gauss.ska(v, EXPO, 30, 256)
    centers, rest = rows[:6], rows[6:]
    points = _weights(spark, [(i, w * 6) for i, w in centers]).join(v.select("id", "x"), "id")
    mean = exact.kde(sampling.pick_set(v.select("id", "x"), 256, "ska"), asked(points), EXPO)
    sums = exact.kernel_sums(points, asked(points), EXPO, weights=["weight"]).join(mean, "qid")
    missed = sums.select(F.col("qid").alias("id"), F.lit(True).alias("center"), F.abs(F.round(F.col("sum") - F.col("density"), 9)).alias("value"))
    return missed.unionByName(_weights(spark, rest).select("id", F.lit(False).alias("center"), F.round("weight", 9).alias("value")))


# -------------------------------------------------------------------- adaptive
A_TAU, A_EPS = 1 / 16, 0.8
A_LEVELS = estimators.levels(A_TAU, A_EPS)
FOLD_KERNEL = Exponential(0.8)


def _walk_sql(levels: list[estimators.Level], cost: str = "m * 3", skip: bool = True) -> str:
    """The walk over levels, from a relation lv(qid, level, est)."""
    rows = _level_rows(levels)
    stop, jump = (f"est >= mu or {cost} > (select count(*) from points)", "case when est > 0 then floor(ln(est) / ln(0.5::double))::int else lv.level + 1 end") if skip else ("est >= mu", "lv.level + 1")
    return f"""lt as (select * from ({rows}) as t(level, mu, m)),
step as (select qid, lv.level, est, {cost} as cost, {stop} as stop, greatest({jump}, lv.level + 1) as next from lv join lt on lt.level = lv.level),
walk as (select qid, level, est, cost::bigint as samples, stop, next from step where level = 0
    union all select s.qid, s.level, s.est, w.samples + s.cost, s.stop, s.next from walk w join step s on s.qid = w.qid and s.level = w.next where not w.stop)
select qid, round(arg_max(est, level), 9) as est, max(samples)::bigint as samples, max(level)::int as level from walk group by qid"""


def _ars_levels(levels: list[estimators.Level] = A_LEVELS, salt: str = "ars") -> str:
    out = []
    for x in levels:
        out.append(f"select qid, {x.level} as level, median(e) as est from (select qid, r // {x.m} as g, avg({FOLD_KERNEL.sql('d2')}) as e from ({_draws_sql(x.m * 3, f'{salt}{x.level}')}) join rows_ using (row) join pairs using (qid, id) group by all) group by qid")
    return " union all ".join(out)


@query(f"with recursive {P}, {_rows()}, lv as ({_ars_levels()}), {_walk_sql(A_LEVELS)}")
def adaptive_rs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.adaptive_rs(v, asked(v), FOLD_KERNEL, A_TAU, A_EPS), "est")


R_LEVELS = estimators.relaxation_levels(1 / 4, 0.8)


@query(f"""with recursive {P}, {_rows()}, lv as ({_ars_levels(R_LEVELS, "amr")}), lt as (select * from ({_level_rows(R_LEVELS)}) as t(level, mu, m)),
step as (select qid, lv.level, est, m * 3 as cost, est >= mu as stop from lv join lt on lt.level = lv.level),
walk as (select qid, level, est, cost::bigint as samples, stop from step where level = 0 union all select s.qid, s.level, s.est, w.samples + s.cost, s.stop from walk w join step s on s.qid = w.qid and s.level = w.level + 1 where not w.stop)
select qid, round(arg_max(est, level), 9) as est, max(samples)::bigint as samples, max(level)::int as level from walk group by qid""")
def mean_relaxation(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.adaptive_rs(v, asked(v), FOLD_KERNEL, 1 / 4, 0.8, salt="amr", skip=False), "est")


@query(f"""with {P}, {_rows()}, lv as ({_ars_levels()}), truth as (select qid, avg({FOLD_KERNEL.sql("d2")}) as density from pairs group by qid)
select qid, coalesce(min(level) filter (abs(est - density) <= 0.1 * density), {len(A_LEVELS) - 1})::int as level from lv join truth using (qid) group by qid""")
def diag_actual_level(spark, sf_dir):
    v = vectors(spark, sf_dir)
    est = estimators.rs_levels(v, asked(v), FOLD_KERNEL, A_LEVELS, v.count())
    return diagnose.actual_level(est, exact.kde(v, asked(v), FOLD_KERNEL), len(A_LEVELS) - 1, 0.1)


def _hbe_levels_sql(levels: list[estimators.Level], groups: int, tables: int) -> str:
    """(qid, level, est) of hashing estimates: at each level the median over groups of tables."""
    out = []
    for x in levels:
        for g in range(groups):
            h, p = estimators.level_hashes(x, g, D, tables), f"{x.level}/{g}"
            collide = scalar.collision_sql("sqrt(d2)", repr(h.width), f"{float(x.k)}")
            keyed = h.sql("points")
            table = f"select tbl, key, count(*) / (select count(*) from points)::double as mass, {_race(salt=f'ah{p}')} as id from ({keyed}) group by tbl, key"
            z = f"select qid, sum({FOLD_KERNEL.sql('d2')} / {collide} * mass) as z from (select k.id as qid, t.id, t.mass from ({keyed}) k join ({table}) t using (tbl, key)) join pairs using (qid, id) group by qid"
            out.append(f"select qid, {x.level} as level, coalesce(z, 0) / {tables} as e from queries left join ({z}) using (qid)")
    return f"select qid, level, median(e) as est from ({' union all '.join(out)}) group by qid, level"


RH_LEVELS = estimators.relaxation_levels(1 / 4, 0.8, Gaussian())


@query(f"with recursive {P}, lv as ({_hbe_levels_sql(RH_LEVELS, 1, 4)}), {_walk_sql(RH_LEVELS, '4', False)}")
def relaxation_hbe(spark, sf_dir):
    """Mean relaxation over hashing levels, from density one on."""
    v = vectors(spark, sf_dir)
    return rounded(estimators.adaptive_hbe(v, asked(v), FOLD_KERNEL, RH_LEVELS, D, groups=1, tables=4, skip=False), "est")


AH_LEVELS = estimators.levels(1 / 8, 0.8, Gaussian())


@query(f"with recursive {P}, lv as ({_hbe_levels_sql(AH_LEVELS, 3, 4)}), {_walk_sql(AH_LEVELS, '12')}")
def adaptive_hbe(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.adaptive_hbe(v, asked(v), FOLD_KERNEL, AH_LEVELS, D, tables=4), "est")


D_LEVELS = [estimators.Level(x.level, x.mu, 3 * x.m, 0.0, 0, 0.0) for x in A_LEVELS]
_DIAGNOSED = " union all ".join(
    f"select qid, level, case when {x.m} * 3 > (select count(*) from points) then full_ else est end as est from ({_ars_levels([d], 'diag')}) join (select qid, avg({FOLD_KERNEL.sql('d2')}) as full_ from pairs group by qid) using (qid)"
    for x, d in zip(A_LEVELS, D_LEVELS, strict=True)
)
_DIAG_COST = "case when m * 3 > (select count(*) from points) then (select count(*) from points) else m * 9 end"


@query(f"with recursive {P}, {_rows()}, lv as ({_DIAGNOSED}), {_walk_sql(A_LEVELS, _DIAG_COST).replace(f'or {_DIAG_COST} >', 'or m * 9 >')}")
def adaptive_rs_diagnosed(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(estimators.adaptive_rs_diagnosed(v, asked(v), FOLD_KERNEL, A_TAU, A_EPS), "est")


_TRUE = f"truth as (select qid, avg({EXPO.sql('d2')}) as density from pairs group by qid)"


@query(f"with {P}, {_TRUE} select qid from truth join queries using (qid) where density >= (select median(density) from truth)")
def queries_above(spark, sf_dir):
    """Queries whose exact density reaches a bound: here the median."""
    v = vectors(spark, sf_dir)
    truth = exact.kde(v, asked(v), EXPO)
    tau = truth.agg(F.median("density")).first()[0]
    return estimators.above(truth, asked(v), tau, "density").select("qid")


@query(f"""with {P}, {_rows()}, drawn as ({_draws_sql(64, "rs")}), est as (select qid, avg({GAUSS.sql("d2")}) as est from drawn join rows_ using (row) join pairs using (qid, id) group by qid)
select qid from est where est >= 0.001 order by {uniform_sql("qid", "'redraw'")}, qid limit 40""")
def queries_redrawn(spark, sf_dir):
    """Forty queries whose estimate reaches a bound; others are drawn anew."""
    v = vectors(spark, sf_dir)
    return estimators.drawn_above(asked(v), lambda q: estimators.random_sampling(v, q, GAUSS, 64), 0.001, 40).select("qid")


@query(f"""with {P}, {_rows()}, e as ({" union all ".join(f"select qid, avg({GAUSS.sql('d2')}) as e from ({_draws_sql(40, f'mom/{g}')}) join rows_ using (row) join pairs using (qid, id) group by qid" for g in range(3))}),
m as (select qid, median(e) as est from e group by qid) select qid, round(case when est < 0.002 then 0 else est end, 9) as est from m""")
def mean_of_means(spark, sf_dir):
    """The median of means of an estimator of one's own, small estimates as zero."""
    v = vectors(spark, sf_dir)
    return rounded(estimators.mean_of_means(lambda q, m, salt: estimators.random_sampling(v, q, GAUSS, m, salt), asked(v), 40, 3, 0.002), "est")


# ------------------------------------------------------------------- diagnosis
def _diag_ctes(width: float, power: int, p: str = "") -> str:
    """Rings and their statistics, the last as <p>stats."""
    return f"""{p}con as (select qid, id, {GAUSS.sql("d2")} as c, {scalar.collision_sql("sqrt(d2)", repr(width), repr(float(power)))} as p from pairs), {p}con1 as (select * from {p}con where c < 1),
{p}m as (select *, count(*) over (partition by qid) as n, avg(c) over (partition by qid) as u from {p}con1),
{p}h as (select *, sum(case when c < u then c else 0 end) over (partition by qid) / n as u4,
  coalesce(sum(case when c >= u then c else 0 end) over (partition by qid order by c, id rows between unbounded preceding and 1 preceding), 0) / n as up,
  coalesce(sum(c) over (partition by qid order by c desc, id desc rows between unbounded preceding and 1 preceding), 0) / n as down from {p}m),
{p}rings as (select *, case when c < u then 4 when up < (0.5 * u - u4) / 2 then 3 when down < (0.5 * u - u4) / 2 then 1 else 2 end as ring from {p}h),
{p}stats as (select qid, ring, count(*) as cnt, sum(c) / max(n) as mass, count(*) / max(n) as share, coalesce(max(c) filter (c >= 1e-10), 0) as w_max, coalesce(min(c) filter (c >= 1e-10), 1) as w_min,
  coalesce(min(p) filter (c >= 1e-10), 1) as p_min, max(c / p) filter (c >= 1e-10) as wp_max, min(c / p) filter (c >= 1e-10) as wp_min, max(c / p / p) filter (c >= 1e-10) as wpp_max from {p}rings group by qid, ring)"""


DIAG_QUERIES = P.replace("queries as (select id as qid, x as q, label as qlabel from points)", f"queries as (select id as qid, x as q, label as qlabel from points order by {uniform_sql('id', chr(39) + 'diag' + chr(39))}, id limit 300)")
DIAG_SAMPLED = f"with {DIAG_QUERIES}, {_diag_ctes(1.5, 4)}"


def _stats(spark, sf_dir):
    v = vectors(spark, sf_dir)
    # a diagnosis takes a bounded sample of queries by its nature
    q = sampling.pick_set(asked(v), 300, "diag", "qid")
    return diagnose.ring_stats(diagnose.ringed(diagnose.contributions(v, q, GAUSS, 1.5, 4)))




@query(f"{DIAG_SAMPLED} select qid, ring::int as ring, cnt, round(mass, 9) as mass, round(w_max, 9) as w_max, round(w_min, 9) as w_min from stats")
def diag_rings(spark, sf_dir):
    return _stats(spark, sf_dir).select("qid", "ring", "cnt", *[F.round(c, 9).alias(c) for c in ("mass", "w_max", "w_min")])


@query(f"""{DIAG_SAMPLED}, two as (select a.qid, sum(a.w_max / b.w_min * a.mass * b.mass) as rs from stats a join stats b using (qid) where a.ring < 4 and b.ring < 4 group by a.qid),
one as (select a.qid, sum(l.share * a.w_max * a.mass) as rs from stats a join stats l using (qid) where a.ring < 4 and l.ring = 4 group by a.qid)
select qid, round(two.rs + coalesce(one.rs, 0) + coalesce(l.w_max * l.mass, 0), 9) as rs from two left join one using (qid) left join (select * from stats where ring = 4) l using (qid)""")
def diag_bound_rs(spark, sf_dir):
    return diagnose.variance_bounds(_stats(spark, sf_dir)).select("qid", F.round("rs", 9).alias("rs"))


def _hbe_bound(stats: str = "stats") -> str:
    return f"""select qid, two.b + coalesce(one.b, 0) + coalesce(l.wp_max * l.mass, 0) as hbe from
(select a.qid, sum(coalesce(case when a.ring = b.ring then greatest(1 / a.p_min, a.wpp_max / a.wp_min) when a.ring < b.ring then a.wpp_max / b.wp_min else a.wp_max / b.w_min end, 0) * a.mass * b.mass) as b
    from {stats} a join {stats} b using (qid) where a.ring < 4 and b.ring < 4 group by a.qid) two
left join (select a.qid, sum(coalesce(l.share * a.wpp_max, 0) * a.mass) as b from {stats} a join {stats} l using (qid) where a.ring < 4 and l.ring = 4 group by a.qid) one using (qid)
left join (select * from {stats} where ring = 4) l using (qid)"""


@query(f"{DIAG_SAMPLED} select qid, round(hbe, 6) as hbe from ({_hbe_bound()})")
def diag_bound_hbe(spark, sf_dir):
    return diagnose.variance_bounds(_stats(spark, sf_dir)).select("qid", F.round("hbe", 6).alias("hbe"))


SCHEMES = {"narrow": (1.0, 2), "middle": (1.5, 4), "wide": (4.0, 8)}


_SCHEME_CTES = ", ".join(_diag_ctes(w, k, f"{name}_") for name, (w, k) in SCHEMES.items())


@query(f"with {DIAG_QUERIES}, {_SCHEME_CTES} " + " union all ".join(f"select qid, '{name}' as scheme, round(hbe, 6) as hbe from ({_hbe_bound(f'{name}_stats')})" for name in SCHEMES))
def scheme_bounds(spark, sf_dir):
    """Bounds of several hashing schemes at once."""
    v = vectors(spark, sf_dir)
    q = sampling.pick_set(asked(v), 300, "diag", "qid")
    return diagnose.scheme_bounds(v, q, GAUSS, SCHEMES).select("qid", "scheme", F.round("hbe", 6).alias("hbe"))


# ------------------------------------------------------------------- clustering
def _kcenter_sql(k: int) -> str:
    """Farthest-point seeds by a fixed unroll."""
    ctes = ["k0 as (select 0 as n, id, x from points order by id limit 1)"]
    for i in range(1, k):
        ctes.append(f"k{i} as (select * from k{i - 1} union all (select {i}, p.id, p.x from points p, k{i - 1} s group by p.id, p.x order by min(pow(p.x[1] - s.x[1], 2) + pow(p.x[2] - s.x[2], 2)) desc, p.id limit 1))")
    return ", ".join(ctes) + f", own as (select p.id, p.x, arg_min(s.n, [pow(p.x[1] - s.x[1], 2) + pow(p.x[2] - s.x[2], 2), s.n]) as cluster from points p, k{k - 1} s group by p.id, p.x)"


@query(f"with {PART}, {_kcenter_sql(8)}, c as (select cluster, avg(x[1]) as a, avg(x[2]) as b, count(*) as n from own group by cluster) select cluster::int as cluster, n, round(a, 7) as a, round(b, 7) as b, round(sqrt(max(pow(x[1] - a, 2) + pow(x[2] - b, 2))), 7) as radius from own join c using (cluster) group by all")
def kcenter_summary(spark, sf_dir):
    v = parts(spark, sf_dir).cache()
    s = cluster.summary(v, cluster.kcenter(v, 8))
    return s.select("cluster", "n", F.round(F.col("center")[0], 7).alias("a"), F.round(F.col("center")[1], 7).alias("b"), F.round("radius", 7).alias("radius"))


def _nearest_sql(c: str) -> str:
    """(id, x, cluster, d) of the points by the nearest center of a relation (cluster, m)."""
    return f"select p.id, p.x, arg_min(c.cluster, [pow(p.x[1] - c.m[1], 2) + pow(p.x[2] - c.m[2], 2), c.cluster]) as cluster, min(pow(p.x[1] - c.m[1], 2) + pow(p.x[2] - c.m[2], 2)) as d from points p, {c} c group by p.id, p.x"


def _lloyd_sql(first: str, rounds: int, p: str = "c") -> str:
    """Centers <p><rounds> after so many steps from a relation <p>0 of (cluster, m)."""
    steps = [f"{p}{i} as (select cluster, [avg(x[1]), avg(x[2])] as m from ({_nearest_sql(f'{p}{i - 1}')}) group by cluster)" for i in range(1, rounds + 1)]
    return ", ".join([f"{p}0 as ({first})", *steps])


@query(f"with {PART}, {_kcenter_sql(5)}, {_lloyd_sql('select n as cluster, x as m from k4', 1)} select cluster::int as cluster, count(*) as n from ({_nearest_sql('c1')}) group by cluster")
def kmeans_one_step(spark, sf_dir):
    v = parts(spark, sf_dir).cache()
    centers, _ = cluster.lloyd(v, [x for _, x in cluster.kcenter(v, 5)], rounds=1, tolerance=-1.0)
    return cluster.assigned(v, centers).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"with {PART}, {_kcenter_sql(5)}, c as (select cluster, avg(x[1]) as a, avg(x[2]) as b, count(*) as n from own group by cluster), g as (select avg(x[1]) as a, avg(x[2]) as b from points) select round((select sum(n * (pow(c.a - g.a, 2) + pow(c.b - g.b, 2))) from c, g) / (select sum(pow(x[1] - a, 2) + pow(x[2] - b, 2)) from own join c using (cluster)), 7) as ratio")
def kmeans_variance_ratio(spark, sf_dir):
    v = parts(spark, sf_dir).cache()
    return cluster.variance_ratio(v, [x for _, x in cluster.kcenter(v, 5)]).select(F.round("ratio", 7).alias("ratio"))


def _seeds_sql(k: int) -> str:
    """Seeds by squared distance, as rows (cluster, m) s0 ... of k relations that grow."""
    out = [f"s0 as (select 0 as cluster, x as m from points order by {uniform_sql('id', chr(39) + 'seed0' + chr(39))} limit 1)"]
    for i in range(1, k):
        u = uniform_sql("id", f"'seed{i}'")
        out.append(f"s{i} as (select * from s{i - 1} union all (select {i}, x from ({_nearest_sql(f's{i - 1}')}) where d > 0 order by -ln({u}) / d, id limit 1))")
    return ", ".join(out)


@query(f"with {PART}, {_seeds_sql(4)}, {_lloyd_sql('select * from s3', 6)} select cluster::int as cluster, round(m[1], 6) as a, round(m[2], 6) as b, n from c6 join (select cluster, count(*) as n from ({_nearest_sql('c6')}) group by cluster) using (cluster)")
def kmeans_lloyd(spark, sf_dir):
    """Six steps from seeds by distance."""
    v = parts(spark, sf_dir).cache()
    centers, _ = cluster.lloyd(v, cluster.seeds_by_distance(v, 4), rounds=6, tolerance=-1.0)
    rows = spark.createDataFrame([(k, round(a, 6), round(b, 6)) for k, (a, b) in enumerate(centers)], "cluster int, a double, b double")
    return rows.join(cluster.assigned(v, centers).groupBy("cluster").agg(F.count("*").alias("n")), "cluster")


@query(f"with {PART}, {_kcenter_sql(8)} select n::int as place, id from k7")
def kcenter_more(spark, sf_dir):
    """Four more centers for four given ones."""
    v = parts(spark, sf_dir).cache()
    seeds = cluster.kcenter(v, 8, seeds=cluster.kcenter(v, 4))
    return spark.createDataFrame([(k, i) for k, (i, _) in enumerate(seeds)], "place int, id long")


FOLDS = 3
_FOLDS_SQL = ", ".join(_lloyd_sql(f"select row_number() over (order by u, id) - 1 as cluster, x as m from (select id, x, {uniform_sql('id', f'{chr(39)}fold{f}{chr(39)}')} as u from points order by u, id limit 4)", 3, f"f{f}_") for f in range(FOLDS))
_SIZES_SQL = " union all ".join(f"select {f} as f, case when count(*) = 4 then min(n) / max(n) else 0 end as score from (select cluster, count(*) as n from ({_nearest_sql(f'f{f}_3')}) group by cluster)" for f in range(FOLDS))


@query(f"with {PART}, {_FOLDS_SQL}, best as (select arg_min(f, [-score, f]) as f from ({_SIZES_SQL})) select cluster::int as cluster, round(m[1], 7) as a, round(m[2], 7) as b from ({' union all '.join(f'select {f} as f, * from f{f}_3' for f in range(FOLDS))}) join best using (f)")
def kmeans_balanced(spark, sf_dir):
    """The most even of three runs of three steps."""
    centers = cluster.balanced(parts(spark, sf_dir).cache(), 4, FOLDS, rounds=3, tolerance=-1.0)
    return spark.createDataFrame([(k, round(a, 7), round(b, 7)) for k, (a, b) in enumerate(centers)], "cluster int, a double, b double")


def _elimination_sql(k: int, extra: int) -> str:
    out = [f"e0 as (select * from s{k + extra - 1})"]
    for n in range(extra):
        out.append(f"""l{n} as (select cluster, sum(d2 - d) as loss from (select cluster, d, lead(d) over (partition by id order by d, cluster) as d2, row_number() over (partition by id order by d, cluster) as r
  from (select p.id, c.cluster, pow(p.x[1] - c.m[1], 2) + pow(p.x[2] - c.m[2], 2) as d from points p, e{n} c)) where r = 1 group by cluster)""")
        out.append(f"e{n + 1} as (select * from e{n} where cluster <> (select cluster from e{n} left join l{n} using (cluster) order by coalesce(loss, 0), cluster limit 1))")
    return ", ".join(out)


@query(f"with {PART}, {_seeds_sql(6)}, {_elimination_sql(4, 2)} select (row_number() over (order by cluster) - 1)::int as cluster, round(m[1], 7) as a, round(m[2], 7) as b from e2")
def seeds_by_elimination(spark, sf_dir):
    """Six seeds, less the two whose loss costs least."""
    centers = cluster.seeds_by_elimination(parts(spark, sf_dir).cache(), 4, 2)
    return spark.createDataFrame([(k, round(a, 7), round(b, 7)) for k, (a, b) in enumerate(centers)], "cluster int, a double, b double")


# ------------------------------------------------------------- Gauss transform
@query("""select a::int as a, b::int as b, round(pow(2.0::double, a + b) / (factorial(a::int) * factorial(b::int))::double, 12) as factor, round(pow(0.5::double, a) * pow(-1.5::double, b), 12) as value
from range(7) s(a), range(7) t(b) where a + b < 7""")
def series_terms(spark, sf_dir):
    """All monomials of two variables below degree 7, at a point, and their factors in the series."""
    alpha = gauss.multi_indices(2, 7)
    value = gauss.monomials(np.array([[0.5, -1.5]]), alpha)[0]
    rows = [(int(a), int(b), round(float(f), 12), round(float(v), 12)) for (a, b), f, v in zip(alpha, gauss.series(alpha), value, strict=True)]
    return spark.createDataFrame(rows, "a int, b int, factor double, value double")


IFGT_H, IFGT_EPS = 0.4, 1e-3


@query(f"with {PART_PAIRS} select qid, 0 as wset, round(sum({Gaussian(IFGT_H).sql('d2')}), 6) as g from pairs group by qid")
def ifgt_gauss(spark, sf_dir):
    """To an error far below the places that are compared."""
    v = parts(spark, sf_dir).cache()
    return rounded(gauss.gauss_transform(v, asked(v), IFGT_H, 1e-13, 48), "g", places=6)


_EXACT_G = f"exact as (select qid, sum({Gaussian(IFGT_H).sql('d2')}) as g from pairs group by qid)"


def _of_cut_off(name: str, cut_off: str) -> None:
    """Whether each target's error is within eps times the sum of weights, and how the exact sum, rounded, reads."""

    def compared(v):
        n = v.agg(F.sum("w").alias("n")).first()["n"]
        full = exact.kernel_sums(v, asked(v), Gaussian(IFGT_H), weights=["w"], copies=False).select("qid", "sum")
        found = gauss.gauss_transform(v, asked(v), IFGT_H, IFGT_EPS, 24, cut_off=cut_off, copies=False).join(full, "qid")
        return found.select("qid", F.round("sum", 6).alias("exact"), (F.abs(F.col("g") - F.col("sum")) <= IFGT_EPS * n).alias("within"))

    def run(spark, sf_dir):
        return at_places(raw_parts(spark, sf_dir), compared)

    run.__name__ = name
    query(f"with {PART_PAIRS}, {_EXACT_G} select qid, round(g, 6) as exact, true as within from exact")(run)


_of_cut_off("ifgt_bound", gauss.ONE)
_of_cut_off("ifgt_bound_by_cluster", gauss.BY_CLUSTER)
_of_cut_off("ifgt_bound_by_point", gauss.BY_POINT)


@query(f"with {PART_PAIRS} select qid, round(sum(case when d2 <= {IFGT_H**2 * math.log(1 / IFGT_EPS)!r}::double then {Gaussian(IFGT_H).sql('d2')} else 0 end), 6) as g from pairs group by qid")
def gauss_direct_tree(spark, sf_dir):
    """Only points of the leaves that a query's reach meets."""
    v = parts(spark, sf_dir)
    reach = IFGT_H * math.sqrt(math.log(1 / IFGT_EPS))
    return cells.kernel_sums(v, asked(v), Gaussian(IFGT_H), reach).select("qid", F.round("sum", 6).alias("g"))


TREE_KERNEL = Gaussian(0.5)
_TREE_EXACT = f"with {PART_PAIRS} select qid, round(sum(w * {TREE_KERNEL.sql('d2')}), 6) as exact, true as within from (select qid, %s::double as w, d2 from pairs%s) group by qid"


def _against(found: DataFrame, v: DataFrame, q: DataFrame, weight: str, copies: bool = True) -> DataFrame:
    """The exact sums, and whether a treecode's differ by a thousandth of all weights at most."""
    total = v.agg(F.sum(weight).alias("t")).first()["t"]
    full = exact.kernel_sums(v, q, TREE_KERNEL, weights=[weight], copies=copies).select("qid", "sum")
    return found.join(full, "qid").select("qid", F.round("sum", 6).alias("exact"), (F.abs(F.col("potential") - F.col("sum")) <= 1e-3 * total).alias("within"))


@query(_TREE_EXACT % ("1", ""))
def treecode(spark, sf_dir):
    return at_places(raw_parts(spark, sf_dir), lambda v: _against(gauss.skeleton_transform(v, asked(v), TREE_KERNEL, 4, 64, 0.5, 1024, copies=False), v, asked(v), "w", copies=False))


@query(_TREE_EXACT % ("1 + id % 3", " where qid % 2 = 1"))
def treecode_new_charges(spark, sf_dir):
    """One tree, other charges, and other targets than all points."""
    v = parts(spark, sf_dir).withColumn("w2", (F.col("id") % 3 + 1).cast("double")).cache()
    kept = gauss.Treecode.fit(v, TREE_KERNEL, 4, 64, 0.5, 1024)
    some = asked(v).where("qid % 2 = 1")
    return _against(kept.potentials(some, v.select("id", F.col("w2").alias("w"))), v, some, "w2")


@query(_TREE_EXACT % ("1 + id % 3", ""))
def treecode_mutual(spark, sf_dir):
    """Leaves acting on leaves, potentials passed down to the points."""
    v = parts(spark, sf_dir).withColumn("w2", (F.col("id") % 3 + 1).cast("double")).cache()
    kept = gauss.Treecode.fit(v, TREE_KERNEL, 4, 64, 0.5, 1024)
    return _against(kept.mutual_potentials(v.select("id", F.col("w2").alias("w"))), v, asked(v), "w2")


# ----------------------------------------------------------------------- trees
NODES = "node_ as (select n::bigint as n from range(1, 64) t(n)), two as (select a.n as a, b.n as b, length(bin(a.n)) - 1 as la, length(bin(b.n)) - 1 as lb from node_ a, node_ b)"


@query(f"with {NODES} select a, b, lb > la and (b >> greatest(lb - la, 0)) = a as above, (a + 1) * (2 ** (5 - la))::bigint * 6 - 6 + 5 - la < (b + 1) * (2 ** (5 - lb))::bigint * 6 - 6 + 5 - lb as before from two")
def tree_predicates(spark, sf_dir):
    n = spark.range(1, 64)
    two = n.select(F.col("id").alias("a")).crossJoin(n.select(F.col("id").alias("b")))
    a, b = F.col("a"), F.col("b")
    return two.select("a", "b", tree.is_ancestor(a, b).alias("above"), (tree.tree_order(a, 5) < tree.tree_order(b, 5)).alias("before"))


@query(f"""with {P}, {_tree_sql(4, "sp")}, near as (select distinct qid, leaf from (select k.qid, s.leaf from (select * from ({KNN}) where rank <= 3) k join sp s on s.id = k.id union all select id, leaf from sp)),
kept as (select distinct qid, leaf >> s as node from near, range(5) t(s) where leaf >> s >= 1), far as (select distinct qid, xor(node, 1) as node from kept where node > 1)
select f.node, count(*) as n, sum(f.qid)::bigint as ids from far f anti join kept using (qid, node) group by f.node""")
def interaction_lists(spark, sf_dir):
    v = vectors(spark, sf_dir)
    leaves = cluster.space_partition(v, 4, D, "sp", keep=("id", "x")).select("id", "leaf")
    lists = knn.knn(v, asked(v), 3).select("qid", "id").join(leaves, "id").select("qid", "leaf")
    return tree.inverted(tree.interaction_lists(leaves.select(F.col("id").alias("qid"), "leaf"), lists, 4)[1])


@query(f"""with {P}, {_tree_sql(3, "sp")}, total as (select count(*) as n from points), rows_ as (select id, leaf as own, row_number() over (order by id) - 1 as row from sp),
near as (select distinct s.leaf, k.id from (select * from ({KNN}) where rank <= 3) k join sp s on s.id = k.qid),
drawn as (select leaf, r, least(floor({uniform_sql("leaf || '/' || r", "'far'")} * n)::bigint, n - 1) as row from (select distinct leaf from sp), range(400) t(r), total),
found as (select leaf, id, min(r) as r from drawn join rows_ using (row) where leaf <> own group by leaf, id)
select leaf, id from (select f.*, row_number() over (partition by f.leaf order by r) as k from found f anti join near using (leaf, id)) where k <= 10""")
def far_field_sample(spark, sf_dir):
    """Ten rows far from each leaf: not in it, and not among the neighbours of its points."""
    v = vectors(spark, sf_dir)
    leaves = cluster.space_partition(v, 3, D, "sp").select("id", "leaf").cache()
    near = knn.knn(v, asked(v), 3).select("qid", "id").join(leaves.select(F.col("id").alias("qid"), "leaf"), "qid").select("leaf", "id").distinct()
    return tree.far_sample(leaves, near, 10)


# --------------------------------------------------------------------- metrics
@query(f"""with {P}, {_rows()}, drawn as ({_draws_sql(64, "rs")}), est as (select qid, avg({GAUSS.sql("d2")}) as est from drawn join rows_ using (row) join pairs using (qid, id) group by qid),
truth as (select qid, avg({GAUSS.sql("d2")}) as density from pairs group by qid), e as (select *, abs(est - density) as d, abs(est - density) / density as rel from est join truth using (qid))
select count(*) as n, round(avg(rel), 8) as mean_rel, round(max(rel), 8) as max_rel, round(avg(d), 8) as mean_abs, round(max(d), 8) as max_abs, round(sqrt(sum(d * d)) / sqrt(sum(density * density)), 8) as l2, round(max(d) / max(density), 8) as inf, round(stddev_pop(rel) / sqrt(count(*)), 8) as se_rel from e""")
def error_report(spark, sf_dir):
    v = vectors(spark, sf_dir)
    r = metrics.error_report(estimators.random_sampling(v, asked(v), GAUSS, 64), exact.kde(v, asked(v), GAUSS))
    return rounded(r, *[c for c in r.columns if c != "n"], places=8)


@query(f"""with {P}, {_rows()}, drawn as ({_draws_sql(64, "rs")}), est as (select qid, avg({GAUSS.sql("d2")}) as est from drawn join rows_ using (row) join pairs using (qid, id) group by qid),
truth as (select qid, avg({GAUSS.sql("d2")}) as density from pairs group by qid) select qid, round(abs(est - density) / greatest(density, 0.0025), 8) as err from est join truth using (qid)""")
def error_tau_floored(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(metrics.relative_errors(estimators.random_sampling(v, asked(v), GAUSS, 64), exact.kde(v, asked(v), GAUSS), 0.0025), "err", places=8)


@query(f"with {P} select qid, round(avg({EXPO.sql('d2')}) filter (id % 2 = 0), 9) as first, round(avg({EXPO.sql('d2')}) filter (id % 2 = 1), 9) as second from pairs group by qid")
def bandwidth_halves(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(metrics.halves(v, asked(v), EXPO), "first", "second")


# --------------------------------------------------------------- set operations
@query("select vec_id as id, label from embeddings union all select vec_id + 1099511627776, label from embeddings")
def set_concat(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return generate.concat([e, e])


@query("select distinct o_custkey as id from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def set_difference(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return sets.difference(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), c)


@query("select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def set_complement(spark, sf_dir):
    taken = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return sets.complement(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), taken)


@query("select distinct l_orderkey, l_linenumber from lineitem")
def set_distinct(spark, sf_dir):
    return sets.distinct(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


# ------------------------------------------------------------------ generators
@query(f"select id, round({uniform_sql('id || chr(47) || 0', chr(39) + 'u' + chr(39))}, 9) as a, round({uniform_sql('id || chr(47) || 1', chr(39) + 'u' + chr(39))}, 9) as b from range(1000) t(id)")
def generate_uniform(spark, sf_dir):
    return generate.uniform_points(spark, 1000, 2).select("id", F.round(F.col("x")[0], 9).alias("a"), F.round(F.col("x")[1], 9).alias("b"))


@query(f"select id, round({normal_sql('id || chr(47) || 0', 'n')}, 8) as a, round({normal_sql('id || chr(47) || 1', 'n')}, 8) as b from range(1000) t(id)")
def generate_normal(spark, sf_dir):
    return generate.normal_points(spark, 1000, 2).select("id", F.round(F.col("x")[0], 8).alias("a"), F.round(F.col("x")[1], 8).alias("b"))


INSTANCE = generate.Instance(30, 12, 3, 0.01, 30, 0.02)
_FAR = INSTANCE.kernel.inverse(INSTANCE.density)


def _directions(i: generate.Instance, p: str = "") -> str:
    return f"{p}dirs as (select c, j, z / sqrt(sum(z * z) over (partition by c)) as a from (select c, j, {normal_sql('c || chr(47) || j', f'{i.salt}d')} as z from range({i.clusters}) t(c), range({i.d}) u(j)))"


def _instance_sql(i: generate.Instance, p: str = "") -> str:
    parts, base = [], 0
    for s_, r, n in i.layout():
        noise = i.spread * r / math.sqrt(i.d)
        parts.append(f"select id + {base} as id, (id // {n})::int as cluster, {s_} as scale, {r!r}::double as r, {noise!r}::double as noise from range({n * i.clusters}) t(id)")
        base += n * i.clusters
    return f"{p}rows_ as ({' union all '.join(parts)}), {p}long as (select id, cluster, scale, j, a * r + {normal_sql('id || chr(47) || j', f'{i.salt}x')} * noise as v from {p}rows_ join {p}dirs on c = cluster)"


_DIRECTIONS = _directions(INSTANCE)


@query(f"with {_DIRECTIONS}, {_instance_sql(INSTANCE)} select id, cluster, scale, round(sqrt(sum(v * v)), 7) as r, round(sum(v) filter (j = 0), 7) as x0 from long group by all")
def generate_instance(spark, sf_dir):
    x = INSTANCE.frame(spark)
    return x.select("id", "cluster", "scale", F.round(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), 7).alias("r"), F.round(F.col("x")[0], 7).alias("x0"))


@query(f"""with {_DIRECTIONS}, r as (select id, {uniform_sql("id", "'instancer'")} * {_FAR!r}::double as r, floor({uniform_sql("id", "'instancec'")} * {INSTANCE.clusters})::int as c from range(100) t(id))
select 'correlated' as kind, id as qid, round(a * r, 7) as q0 from r join dirs using (c) where j = 0
union all select 'free', id, round({normal_sql("id || chr(47) || 0", "instanceq")} * r / {math.sqrt(INSTANCE.d)!r}::double, 7) from r""")
def generate_queries(spark, sf_dir):
    both = INSTANCE.queries(spark, 100).withColumn("kind", F.lit("correlated")).unionByName(INSTANCE.queries(spark, 100, False).withColumn("kind", F.lit("free")))
    return both.select("kind", "qid", F.round(F.col("q")[0], 7).alias("q0"))


@query(f"""with {_DIRECTIONS}, r as (select id, {uniform_sql("id", "'instancer'")} * {_FAR!r}::double as r, floor({uniform_sql("id", "'instancec'")} * {INSTANCE.clusters})::int as c from range(50) t(id))
select id as qid, round(a * r, 7) as q0 from r join dirs using (c) where j = 0
union all select id + 50, round({normal_sql("id || chr(47) || 0", "instanceq")} * r / {math.sqrt(INSTANCE.d)!r}::double, 7) from r""")
def generate_mixed_queries(spark, sf_dir):
    return generate.mixed_queries(INSTANCE, spark, 50).select("qid", F.round(F.col("q")[0], 7).alias("q0"))


SWEEP = (2000, 4, [1, 5, 20])
_SWEPT = generate.sweep_instances(*SWEEP, density=0.1)


@query("with " + ", ".join(f"{_directions(i, f's{c}_')}, {_instance_sql(i, f's{c}_')}" for c, i in _SWEPT.items()) + " " + " union all ".join(f"select {c} as clusters, id, scale, round(sqrt(sum(v * v)), 7) as r from s{c}_long group by all" for c in _SWEPT))
def generate_sweep(spark, sf_dir):
    """About as many points for each of several numbers of clusters."""
    out = None
    for c, x in generate.sweep(spark, *SWEEP, density=0.1).items():
        own = x.select(F.lit(c).alias("clusters"), "id", "scale", F.round(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), 7).alias("r"))
        out = own if out is None else out.unionByName(own)
    return out


TURNS = generate.Rotation(2, 6, "turn")


def _turned_sql() -> str:
    out, last = [], "select id, x[1] as a, x[2] as b, x[1] as a0, x[2] as b0 from points"
    for n, (i, _, angle) in enumerate(TURNS.turns()):
        c, s = (f"({f(float(angle[0]))!r})::double" for f in (math.cos, math.sin))
        one, two = ("a", "b") if i[0] == 0 else ("b", "a")
        out.append(f"t{n} as (select id, {one} * {c} - {two} * {s} as {one}, {one} * {s} + {two} * {c} as {two}, a0, b0 from ({last}))")
        last = f"select * from t{n}"
    return f"{', '.join(out)} select id, round(a, 8) as a, round(b, 8) as b, round(a0, 8) as a0, round(b0, 8) as b0 from ({last})"


@query(f"with {PART}, {_turned_sql()}")
def rotate_points(spark, sf_dir):
    """Turned, and turned back."""
    v = parts(spark, sf_dir).cache()
    there = TURNS.applied(v)
    both = there.withColumnRenamed("x", "y").join(TURNS.applied(there, back=True), "id")
    return both.select("id", *[F.round(F.col(c)[j], 8).alias(name) for c, names in (("y", "ab"), ("x", ("a0", "b0"))) for j, name in enumerate(names)])


COVARIANCE = np.array([[2.0, 0.5], [0.5, 1.0]])
PART_COVARIANCES = [generate.random_covariance(2, k) for k in range(3)]


def _shapes_sql() -> str:
    z = lambda j, salt: normal_sql(f"id || chr(47) || {j}", salt)
    u = lambda key, salt: uniform_sql(key, f"'{salt}'")
    size = lambda salt: "sqrt(" + " + ".join(f"pow({z(j, salt)}, 2)" for j in range(3)) + ")"
    part = lambda n: f"floor({u('id', 'mp')} * {n})::int"
    turn = generate.rotation(5, 5)[:2, 0].tolist()
    factors = [np.linalg.cholesky(c)[0, 0] for c in PART_COVARIANCES]
    first = {
        "circle": f"cos({part(4)} * {2 * math.pi / 4!r}::double) + {z(0, 'm')} * 0.1",
        "cube": f"({part(8)} % 2) + {z(0, 'm')} * 0.1",
        "random": f"{u(part(4) + ' || chr(47) || 0', 'mc')} + {z(0, 'm')} * 0.1",
        "covariances": f"cos({part(3)} * {2 * math.pi / 3!r}::double) + {z(0, 'm')} * ({np.array(factors).tolist()}::double[])[{part(3)} + 1]",
        "surface": f"{z(0, 's')} / {size('s')}",
        "spheres": f"{z(0, 'b')} / {size('b')} * pow({u('id', 'br')}, {1 / 3!r}::double) * 0.45 + id % 5",
        "line": f"({u('chr(100) || chr(105) || chr(114) || chr(47) || 0', 'l')} - 0.5) * ({u('id', 'l')} * 2 - 1)",
        "gauss": f"{z(0, 'g')} * {float(np.linalg.cholesky(COVARIANCE)[0, 0])!r}::double",
        "embedded": f"{u('id || chr(47) || 0', 'u')} * {turn[0]!r}::double + {u('id || chr(47) || 1', 'u')} * {turn[1]!r}::double",
    }
    return " union all ".join(f"select '{k}' as shape, id, round({v}, 7) as x0 from range(500) t(id)" for k, v in first.items())


@query(_shapes_sql())
def generate_shapes(spark, sf_dir):
    made = {"circle": generate.mixture(spark, 500, 3, 4), "cube": generate.mixture(spark, 500, 3, 8, means="cube"), "random": generate.mixture(spark, 500, 3, 4, means="random"), "covariances": generate.mixture(spark, 500, 2, 3, covariances=PART_COVARIANCES), "surface": generate.sphere_surface(spark, 500, 3), "spheres": generate.spheres(spark, 500, 3, 5), "line": generate.line(spark, 500, 3), "gauss": generate.gaussian_points(spark, 500, COVARIANCE), "embedded": generate.embedded(generate.uniform_points(spark, 500, 2), 2, 5)}
    out = None
    for name, x in made.items():
        own = x.select(F.lit(name).alias("shape"), "id", F.round(F.col("x")[0], 7).alias("x0"))
        out = own if out is None else out.unionByName(own)
    return out


# ---------------------------------------------------------- sources and sinks
def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder of the cluster, or under /tmp where none is set."""
    return shared_path(spark, what)


@query(f"with {P} select qid as idx, round(avg({GAUSS.sql('d2')}), 9) as density from pairs group by qid")
def io_exact_csv(spark, sf_dir):
    v = vectors(spark, sf_dir)
    path = _scratch(spark, "exact")
    matrices.write_exact(exact.kde(v, asked(v), GAUSS), path)
    return matrices.read_exact(spark, path).select("idx", F.round("density", 9).alias("density"))


@query(f"with {P} select qid, rank, round(d2, 8) as dist2, id from ({KNN}) where rank <= 3")
def io_knn_text(spark, sf_dir):
    v = vectors(spark, sf_dir)
    path = _scratch(spark, "knn")
    matrices.write_knn(knn.knn(v, asked(v), 3), path)
    return rounded(matrices.read_knn(spark, path), "dist2", places=8)


@query(f"with {PART} select row_number() over (order by id) - 1 as id, round((x[2]::float)::double, 6) as b from points")
def io_matrix_csv(spark, sf_dir):
    """Written as a matrix in the order of ids, its second column read back as 32-bit floats."""
    path = _scratch(spark, "matrix")
    matrices.write_matrix(parts(spark, sf_dir).repartitionByRange(4, "id").sortWithinPartitions("id"), path)
    return matrices.read_csv_matrix(spark, path, 1, 1).select("id", F.round(F.col("x")[0], 6).alias("b"))


@query(f"with {P} select qid, round(sum(w * {GAUSS.sql('d2')}), 8) as potential from pairs group by qid")
def io_potentials(spark, sf_dir):
    v = vectors(spark, sf_dir)
    path = _scratch(spark, "potentials")
    matrices.write_potentials(exact.kernel_sums(v, asked(v), GAUSS, weights=["w"]).withColumnRenamed("sum", "potential"), path)
    return rounded(matrices.read_potentials(spark, path), "potential", places=8)


@query(f"with {PART}, {_kcenter_sql(5)}, c as (select n as cluster, x as m from k4) select id, cluster::int as cluster, round(d, 7) as d from ({_nearest_sql('c')})")
def io_clusters(spark, sf_dir):
    """Written as members and centers, read back, and distances taken anew."""
    v = parts(spark, sf_dir).cache()
    centers = [x for _, x in cluster.kcenter(v, 5)]
    path = _scratch(spark, "clusters")
    matrices.write_clusters(cluster.assigned(v, centers).select("id", "cluster"), centers, path)
    members, read_back = matrices.read_clusters(spark, path)
    both = members.join(read_back.select(F.col("id").alias("cluster"), F.col("x").alias("c")), "cluster").join(v, "id")
    return both.select("id", "cluster", F.round(sqdist(F.col("x"), F.col("c")), 7).alias("d"))


@query(f"with {P} select qid, rank, round(d2, 8) as dist2, id from ({KNN}) where rank <= 3")
def io_knn_binary(spark, sf_dir):
    v = vectors(spark, sf_dir)
    path = _scratch(spark, "knn")
    matrices.write_knn_binary(knn.knn(v, asked(v), 4), path, 3)
    return rounded(matrices.read_knn_binary(spark, path, 3), "dist2", places=8)


@query(f"with {P} select row_number() over (order by id) - 1 as id, round(x[1], 8) as first, round(x[64], 8) as last from points")
def io_matrix_binary(spark, sf_dir):
    path = _scratch(spark, "matrix")
    matrices.write_binary_matrix(vectors(spark, sf_dir), path)
    return matrices.read_binary_matrix(spark, path, D).select("id", F.round(F.col("x")[0], 8).alias("first"), F.round(F.col("x")[D - 1], 8).alias("last"))


@query(f"with {PART} select row_number() over (order by id) - 1 as id, round(x[1], 8) as a, round(x[2], 8) as b from points")
def io_matrix_text(spark, sf_dir):
    path = _scratch(spark, "matrix")
    matrices.write_matrix(matrices.in_order(parts(spark, sf_dir), "id"), path, " ")
    return matrices.read_text_matrix(spark, path).select("id", F.round(F.col("x")[0], 8).alias("a"), F.round(F.col("x")[1], 8).alias("b"))


@query(f"with {PART} select * from (select row_number() over (order by id) - 1 as id, round((x[1]::float)::double, 6) as a from points) where id < 50")
def io_matrix_head(spark, sf_dir):
    """The first rows and columns of a matrix, written as queries are."""
    path = _scratch(spark, "queries")
    matrices.write_queries(asked(parts(spark, sf_dir)), path)
    return matrices.read_csv_matrix(spark, path, 0, 0, rows=50).select("id", F.round(F.col("x")[0], 6).alias("a"))


@query(f"with {PART} select 'points' as kind, round(x[1], 8) as a, round(x[2], 8) as b from points union all select 'queries', round(x[1], 8), round(x[2], 8) from points where id % 3 = 1")
def io_convert(spark, sf_dir):
    """Points, and the queries that exact densities name, as lines of numbers."""
    v = parts(spark, sf_dir).cache()
    to = [_scratch(spark, kind) for kind in ("points", "queries")]
    matrices.convert_inputs(v, v.where("id % 3 = 1").select(F.lit(0.5).alias("density"), F.col("id").alias("idx")), *to)
    both = [matrices.read_text_matrix(spark, path).select(F.lit(kind).alias("kind"), "x") for kind, path in zip(("points", "queries"), to, strict=True)]
    return both[0].unionByName(both[1]).select("kind", F.round(F.col("x")[0], 8).alias("a"), F.round(F.col("x")[1], 8).alias("b"))


@query("select count(*) as lines, 4::bigint as files from part")
def io_listing(spark, sf_dir):
    path = _scratch(spark, "listed")
    matrices.write_matrix(parts(spark, sf_dir).repartition(4), path)
    return matrices.listing(spark, path).where("length > 0").agg(F.lit(matrices.line_count(spark, path)).cast("long").alias("lines"), F.count("*").alias("files"))


@query("""with raw as (select row_number() over (order by p_partkey) - 1 as id, (p_size::float)::double as a, (p_retailprice::float)::double as b, 2 * pow(count(*) over (), -1.0::double / 6) * sqrt(2.0::double) as h from part)
select 'points' as side, id, round(a / h, 6) as a, round(b / h, 6) as b from raw union all select 'queries', id, round(a / h, 6), round(b / h, 6) from raw where id < 40""")
def ingest_config(spark, sf_dir):
    """Points and queries of a configuration, scaled by Scott's factor and the bandwidth."""
    raw = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(*[F.col(c).cast("double") for c in ("p_partkey", "p_size", "p_retailprice")]).alias("x"))
    path = _scratch(spark, "ingest")
    matrices.write_matrix(matrices.in_order(raw, "id"), path, ",")
    text = f'other {{ h = "9"; }} parts {{ name = "parts"; fpath = "{path}"; kernel = "gaussian"; d = "2"; m = "40"; h = "2"; start_col = "1"; end_col = "2"; }}'
    points, queries, _, _ = config.ingest(spark, config.KdeConfig.parse(text, "parts"))
    both = points.select(F.lit("points").alias("side"), "id", "x").unionByName(queries.select(F.lit("queries").alias("side"), F.col("qid").alias("id"), F.col("q").alias("x")))
    return both.select("side", "id", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@query("select s_suppkey as id, round(1 / sqrt((select count(*) from supplier)), 9) as charge from supplier")
def source_charges(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return rounded(matrices.with_charges(s, "ones"), "charge")


# ------------------------------------------------------------------- streaming
@query(f"with {KEYS} select tbl, key, count(*) as cnt, count(*)::double as wsum, {_race()} as rep_id from keyed group by tbl, key")
def stream_buckets(spark, sf_dir):
    """Bucket tables kept over a stream of the embeddings' file, in the shared folder."""
    from .streaming.buckets import bucket_stream

    schema = read(spark, sf_dir, "embeddings").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/embeddings.parquet*")
    points = raw.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    path = _scratch(spark, "buckets")
    kept = bucket_stream(points, HASHES).writeStream.outputMode("complete").foreachBatch(lambda table, _: table.write.mode("overwrite").parquet(path))
    kept.option("checkpointLocation", _scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("tbl", "key", "cnt", "wsum", "rep_id")


FLAGSHIP = "exact_kde_gaussian"
