"""Predicates over the nodes of a space partition, and interaction lists.

A node's number is the path of bits from the root below a leading one, so its
parent is half of it, its sibling differs in the last bit, and its level is the
number of bits less one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform


def level(node: Column) -> Column:
    return F.length(F.bin(node)) - 1


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether a is a proper ancestor of b."""
    steps = level(b) - level(a)
    return (steps > 0) & (F.floor(b / F.pow(F.lit(2.0), F.greatest(steps, F.lit(0)))).cast("long") == a)


def tree_order(node: Column, depth: int) -> Column:
    """A number that ascends in post-order over all nodes of a tree of a depth:
    leaves below a node come before it."""
    below = F.lit(depth) - level(node)
    last_leaf = ((node + 1) * F.pow(F.lit(2.0), below)).cast("long") - 1
    return last_leaf * (depth + 1) + below


def ancestors(df: DataFrame, node: str, depth: int) -> DataFrame:
    """df with `node` exploded to itself and all nodes above it."""
    up = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.floor(F.col(node) / F.pow(F.lit(2.0), k)).cast("long"))
    return df.withColumn(node, F.explode(up)).where(F.col(node) >= 1)


def interaction_lists(own: DataFrame, neighbours: DataFrame, depth: int, least_level: int = 1) -> tuple[DataFrame, DataFrame]:
    """(qid, leaf) to be summed exactly and (qid, node) to act as wholes.

    own: qid, leaf of each query; neighbours: qid, leaf of each of its
    neighbours. A node can be pruned if it holds none of them and is not above
    least_level; the far list has the topmost such nodes: the siblings of nodes
    that can't be pruned, less those that can't either."""
    near = own.unionByName(neighbours).select("qid", "leaf").distinct()
    kept = ancestors(near.withColumnRenamed("leaf", "node"), "node", depth).distinct()
    sibling = kept.where("node > 1").select("qid", F.col("node").bitwiseXOR(F.lit(1)).alias("node"))
    return near, sibling.where(level(F.col("node")) >= least_level).join(kept, ["qid", "node"], "left_anti")


def inverted(far: DataFrame) -> DataFrame:
    """node, qids: the queries on which each node acts, as a count and a check sum of ids."""
    return far.groupBy("node").agg(F.count("*").alias("n"), F.sum("qid").alias("ids"))


def far_sample(points: DataFrame, near: DataFrame, m: int, salt: str = "far") -> DataFrame:
    """For each leaf of points (id, leaf) m rows, or all there are, that are neither
    in it nor among `near` (leaf, id): the first of a seeded sequence of draws, as
    many of which are made as that takes."""
    from pyspark.sql import Window

    from .order import dense_index

    near = near.select("leaf", "id").distinct().persist()  # perhaps a search, and met again with every draw
    n = points.count()
    rows = dense_index(points.select("id", F.col("leaf").alias("_own")), ["id"]).persist()
    away = near.join(rows, "id").where("leaf <> _own").groupBy("leaf").agg(F.count("*").alias("_n"))
    sizes = points.groupBy("leaf").agg(F.count("*").alias("_s")).join(away, "leaf", "left")
    wanted = sizes.select("leaf", F.least(F.lit(m), F.lit(n) - F.col("_s") - F.coalesce("_n", F.lit(0))).alias("_w")).persist()
    draws = 2 * m
    while True:
        drawn = wanted.where("_w > 0").select("leaf", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"))
        u = uniform(F.concat_ws("/", F.col("leaf").cast("string"), F.col("r").cast("string")), salt)
        drawn = drawn.withColumn("row", F.least(F.floor(u * n).cast("long"), F.lit(n - 1).cast("long")))
        found = drawn.join(rows, "row").where("leaf <> _own").groupBy("leaf", "id").agg(F.min("r").alias("r")).join(near, ["leaf", "id"], "left_anti")
        kept = found.withColumn("_k", F.row_number().over(Window.partitionBy("leaf").orderBy("r"))).where(F.col("_k") <= m)
        short = wanted.join(kept.groupBy("leaf").agg(F.count("*").alias("_c")), "leaf", "left").where(F.col("_w") > F.coalesce("_c", F.lit(0)))
        if short.isEmpty():
            return kept.select("leaf", "id")
        draws *= 2
