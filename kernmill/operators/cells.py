"""Meetings of queries with only those points that may matter: a k-d partition of
space, leaves that a query's ball meets, and kernel sums, ranges and neighbours by
them.

The partition is fitted on a bounded seeded sample, which decides how much is pruned
and never what is found.  Leaves with more points than one task should hold are cut
into parts by a hash of the id, and a query goes to all of them.  Of a cell with more
queries than one task should hold these are cut into blocks, and the points go to each."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import Kernel
from .sweep import Work, matrix, meeting

#: Points that the partition is fitted on; points of a leaf, if the sample allows; points of a part; queries of a block.
FIT, LEAF, PART, BLOCK = 1 << 16, 1024, 1 << 14, 1 << 14
#: Blocks of a cell are numbered from a multiple of this on.
BLOCKS = 1 << 20


class Space:
    """A complete binary tree of splits at medians of the widest dimension; leaves are numbered from left to right."""

    def __init__(self, x: np.ndarray, levels: int):
        self.levels, d = levels, x.shape[1] if x.ndim == 2 else 0
        self.dim, self.cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        self.low, self.high = np.full((2 << levels, d), -np.inf), np.full((2 << levels, d), np.inf)
        rows = {1: x}
        for node in range(1, 1 << levels):
            own = rows.pop(node)
            if len(own):
                self.dim[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.cut[node] = np.median(own[:, self.dim[node]])
            above = own[:, self.dim[node]] > self.cut[node]
            for child, part in ((2 * node, own[~above]), (2 * node + 1, own[above])):
                rows[child] = part
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, self.dim[node]] = self.low[2 * node + 1, self.dim[node]] = self.cut[node]
        self.low, self.high = self.low[1 << levels :], self.high[1 << levels :]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (x[np.arange(len(x)), self.dim[node]] > self.cut[node])
        return node - (1 << self.levels)

    def met(self, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves whose box a ball of radius r about each row meets."""
        rows, node = np.arange(len(q)), np.ones(len(q), np.int64)
        for _ in range(self.levels):
            t, reach = q[rows, self.dim[node]] - self.cut[node], r[rows]
            left, right = t - reach <= 0, t + reach >= 0
            rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        leaf = node - (1 << self.levels)
        keep = np.ones(len(rows), bool)
        for s in range(0, len(rows) if self.low.shape[1] else 0, 1 << 16):
            at = slice(s, s + (1 << 16))
            apart = np.maximum(np.maximum(self.low[leaf[at]] - q[rows[at]], q[rows[at]] - self.high[leaf[at]]), 0.0)
            keep[at] = (apart * apart).sum(axis=1) <= r[rows[at]] ** 2 * (1 + 1e-9) + 1e-12
        return rows[keep], leaf[keep]


@dataclass
class Cells:
    """Points dealt to cells (`there`: cell and their columns), the partition, and of each leaf its first cell and their number."""

    there: DataFrame
    space: Space
    parts: dict[int, tuple[int, int]]

    @property
    def spark(self) -> SparkSession:
        return self.there.sparkSession

    def asked(self, queries: DataFrame, radius: float | str | None = None, but_own: bool = False) -> DataFrame:
        """queries (qid, q and perhaps a column of radii) with the cells that each
        one's ball meets; without a radius those of its own leaf; but_own: less these."""
        held = self.spark.sparkContext.broadcast((self.space, self.parts))
        at = queries.columns.index(radius) if isinstance(radius, str) else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, parts = held.value
            for batch in batches:
                for b in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                    q = matrix(b.column(1))
                    own = space.leaf(q)
                    if radius is None:
                        rows, leaf = np.arange(len(q)), own
                    else:
                        rows, leaf = space.met(q, np.full(len(q), float(radius)) if at is None else b.column(at).to_numpy(zero_copy_only=False).astype(float))
                        if but_own:
                            rows, leaf = rows[leaf != own[rows]], leaf[leaf != own[rows]]
                    cells = [range(first, first + n) for first, n in (parts.get(x, (0, 0)) for x in leaf.tolist())]
                    taken = b.take(pa.array(np.repeat(rows, [len(c) for c in cells])))
                    flat = np.fromiter((c for own_ in cells for c in own_), np.int64, taken.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), *taken.columns], ["cell", *b.schema.names])

        return queries.mapInArrow(run, T.StructType([T.StructField("cell", T.LongType()), *queries.schema.fields]))


def cells(points: DataFrame, leaf: int = LEAF, part: int = PART, salt: str = "cells") -> Cells:
    """points: id, x and further columns."""
    from .sampling import pick_set

    n = points.count()
    sample = pick_set(points.select("id", "x"), min(FIT, max(n, 1)), salt) if n > FIT else points.select("id", "x")
    space = Space(matrix(sample.select("x").toArrow().column("x")), min(int(math.log2(FIT)) - 4, max(0, math.ceil(math.log2(max(1, n / leaf))))))
    held = points.sparkSession.sparkContext.broadcast(space)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(held.value.leaf(matrix(b.column(1)))), *b.columns], ["cell", *b.schema.names])

    fields = [T.StructField("cell", T.LongType()), *points.schema.fields]
    own = points.mapInArrow(placed, T.StructType(fields))
    sizes = {r["cell"]: r["count"] for r in own.groupBy("cell").count().collect()}  # a row a leaf, FIT / 16 at most
    parts, first = {}, 0
    for k in sorted(sizes):
        parts[k] = (first, -(-sizes[k] // part))
        first += parts[k][1]
    if any(m > 1 for _, m in parts.values()):
        table = points.sparkSession.createDataFrame([(k, f, m) for k, (f, m) in parts.items()], "cell long, _f long, _m long")
        own = own.join(F.broadcast(table), "cell").withColumn("cell", F.col("_f") + F.pmod(F.xxhash64("id"), F.col("_m"))).drop("_f", "_m")
    else:
        names = points.sparkSession.sparkContext.broadcast({k: f for k, (f, _) in parts.items()})

        def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.set_column(0, "cell", pa.array([names.value[k] for k in b.column(0).to_pylist()], pa.int64()))

        own = own.mapInArrow(renamed, T.StructType(fields))
    return Cells(own, space, parts)


def met(there: DataFrame, asked: DataFrame, work: Work, schema: str, radius: str | None = None) -> DataFrame:
    """meeting(), the queries of crowded cells in blocks."""
    sizes = asked.groupBy("cell").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("_n"))
    crowded = sizes.where("_n > 1").persist()
    if crowded.isEmpty():
        return meeting(there, asked, work, schema, radius)
    n = F.coalesce("_n", F.lit(1))
    number = lambda block: (F.col("cell") * BLOCKS + block).alias("cell")
    columns = lambda df: [c for c in df.columns if c != "cell"]
    each = there.join(crowded, "cell", "left").select(F.explode(F.sequence(F.lit(0), n - 1)).alias("_b"), "*").select(number(F.col("_b")), *columns(there))
    own = asked.join(crowded, "cell", "left").select(number(F.pmod(F.xxhash64("qid"), n)), *columns(asked))
    return meeting(each, own, work, schema, radius)


def range_join(points: DataFrame, queries: DataFrame, radius: float | str, most: int | None = None) -> DataFrame:
    """qid, id and dist2 of all points within a radius, as knn.range_join()."""
    from .knn import merge, within

    column = radius if isinstance(radius, str) else None
    queries = queries.select("qid", "q", *([column] if column else []))
    grid = cells(points.select("id", "x"))
    out = met(grid.there, grid.asked(queries, radius), within(radius), "qid long, id long, dist2 double", column)
    return merge(out, most).select("qid", "id", "dist2") if most else out


def range_count(there: DataFrame, asked: DataFrame, radius: float) -> DataFrame:
    """qid and n, the number of points within a radius, of queries with any; there (cell, id, x, _n: the points
    a row stands for) and asked (cell, qid, q) share the cells that a query's ball meets. No pairs are written."""
    from .knn import counting

    return met(there, asked, counting(radius), "qid long, n long").groupBy("qid").agg(F.sum("n").alias("n"))


def kernel_sums(points: DataFrame, queries: DataFrame, kernel: Kernel, radius: float, weights: Sequence[str] = ()) -> DataFrame:
    """qid, wset, sum and n, as exact.kernel_sums() with a radius; a query without a point in reach has sum and n zero."""
    from .exact import summing

    columns, schema, work = summing(points, kernel, weights, radius=radius)
    queries = queries.select("qid", "q")
    grid = cells(points.select(*columns))
    found = met(grid.there, grid.asked(queries, radius), work, schema).groupBy("qid", "wset").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    every = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(max(1, len(weights)) - 1))).alias("wset"))
    zero = F.lit(0).cast("long")
    return every.join(found, ["qid", "wset"], "left").select("qid", "wset", F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce("n", zero).alias("n"))


def knn(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank, dist2 and id of the k nearest points, as knn.knn(): the k-th
    distance in a query's own leaf bounds the ball whose leaves it meets further."""
    from .knn import merge, nearest

    queries = queries.select("qid", "q")
    grid = cells(points.select("id", "x"))
    schema = "qid long, dist2 double, id long"
    own = merge(met(grid.there, grid.asked(queries), nearest(k), schema), k)
    own = own.persist()
    reach = own.groupBy("qid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("dist2"))).alias("r"))
    further = queries.join(reach, "qid", "left").select("qid", "q", F.coalesce("r", F.lit(float("inf"))).alias("r"))
    more = met(grid.there, grid.asked(further, "r", but_own=True), nearest(k), schema, "r")
    return merge(more.unionByName(own.select("qid", "dist2", "id")), k)
