"""Nearest neighbours and range joins: exact, by hashing, and by random trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..functions.vector import sqdist as distance_column
from . import sweep as sweep_module
from .lsh import Hashes
from .sweep import BLOCK_QUERIES, Work, copied, matrix, meeting, once, slices, sqdist, sweep


#: Points, and pairs, of a tile, whose distances stay in a core's cache.
TILE_POINTS, TILE = 2048, 1 << 18


def nearest(k: int) -> Work:
    """For sweep() or meeting(): of each query the k best (qid, dist2, id) of a task's points, ties to the smaller id."""

    def work(qids: np.ndarray, q: np.ndarray, _: None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        size = (q * q).sum(axis=1)

        def meet(rows: slice, x: np.ndarray, ids: np.ndarray, seen: int, most: float) -> None:
            """The best of some queries after a tile of points; seen: points before it."""
            part, held = q[rows], min(seen, k)
            d = sqdist(part, x)
            bound = best_d[rows, k - 1].copy() if seen >= k else np.full(len(part), np.inf)

            def pairs() -> tuple[np.ndarray, np.ndarray]:
                # all that tie with the k-th or that rounding may have put beyond it; exact distances and ids decide
                slack = 1e-9 * bound + 1e-11 * (size[rows] + most)
                return np.nonzero(~(d > (bound + slack)[:, None]))

            i, j = pairs() if seen >= k else (None, None)
            if d.shape[1] > k and (i is None or len(i) > 4 * k * len(part)):
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                bound = np.minimum(bound, _exact(part, x, np.repeat(np.arange(len(part)), k), near.ravel()).reshape(-1, k).max(axis=1))
                i = None
            if i is None:
                i, j = pairs()
            if not len(i):
                return
            hit, at = np.unique(i, return_inverse=True)
            mine = hit + rows.start
            all_q = np.concatenate((np.repeat(np.arange(len(hit)), held), at))
            all_d = np.concatenate((best_d[mine, :held].ravel(), _exact(part, x, i, j)))
            all_i = np.concatenate((best_i[mine, :held].ravel(), ids[j]))
            order = np.lexsort((all_i, all_d, all_q))
            n = np.bincount(all_q, minlength=len(hit))
            place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            order, place = order[place < k], place[place < k]
            best_d[mine[all_q[order]], place], best_i[mine[all_q[order]], place] = all_d[order], all_i[order]

        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = matrix(b.column(1)), b.column(0).to_numpy()
            for t in range(0, len(x), TILE_POINTS):
                own, own_ids = x[t : t + TILE_POINTS], ids[t : t + TILE_POINTS]
                most, step = (own * own).sum(axis=1).max(), max(1, TILE // len(own))
                for s in range(0, len(q), step):
                    meet(slice(s, s + step), own, own_ids, seen, most)
                seen += len(own)
        best_d, best_i = best_d[:, :seen], best_i[:, :seen]
        n = best_d.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(best_d.ravel()), pa.array(best_i.ravel())], ["qid", "dist2", "id"])

    return work


def knn(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank (from 1), dist2 and id of the k nearest points; ties to the
    smaller id. Each partition sends its k best of each query, no more. Copies of
    many queries are asked once, and of many copies of a point only the k of the
    smallest ids can be among the nearest."""
    points, queries, back = points.select("id", "x"), queries.select("qid", "q"), None
    if points.count() * queries.count() >= sweep_module.COPY_PAIRS:
        if copied(points, ["x"]):
            points = points.withColumn("_k", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("_k") <= k).select("id", "x")
        if copied(queries, ["q"]):
            queries, back = once(queries)
    out = merge(sweep(points, queries, nearest(k), "qid long, dist2 double, id long"), k)
    return back(out) if back else out


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs (rows of q, rows of x), summed by component."""
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 14):
        s = slice(k, k + (1 << 14))
        out[s] = ((q[i[s]] - x[j[s]]) ** 2).sum(axis=1)
    return out


def merge(lists: DataFrame, k: int) -> DataFrame:
    """Neighbour lists (qid, dist2, id) of any origin: without repeats, the k best."""
    once = lists.groupBy("qid", "id").agg(F.min("dist2").alias("dist2"))
    order = Window.partitionBy("qid").orderBy("dist2", "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", F.col("rank").cast("int").alias("rank"), "dist2", "id")


def within(radius: float | str) -> Work:
    """For sweep() or meeting(): the pairs (qid, id, dist2) within a radius, of all queries or a column of theirs."""
    column = isinstance(radius, str)

    def work(qids: np.ndarray, q: np.ndarray, radii: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r2 = (radii.astype(float) if column else np.full(len(q), float(radius))) ** 2
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = matrix(b.column(1)), b.column(0).to_numpy()
            for s in slices(len(q), x):
                i, j = np.nonzero(sqdist(q, x[s]) <= r2[:, None] * (1 + 1e-9) + 1e-12)
                exact = _exact(q, x[s], i, j)
                good = exact <= r2[i]
                yield pa.RecordBatch.from_arrays([pa.array(qids[i[good]]), pa.array(ids[s][j[good]]), pa.array(exact[good])], ["qid", "id", "dist2"])

    return work


def counting(radius: float) -> Work:
    """For sweep() or meeting(): of each query the number of points (id, x, and the number _n that
    a row stands for) within a radius."""

    def work(qids: np.ndarray, q: np.ndarray, _: None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q), np.int64)
        for b in batches:
            x, many = matrix(b.column(1)), b.column(2).to_numpy()
            for s in slices(len(q), x):
                i, j = np.nonzero(sqdist(q, x[s]) <= radius**2 * (1 + 1e-9) + 1e-12)
                good = _exact(q, x[s], i, j) <= radius**2
                np.add.at(total, i[good], many[s][j[good]])
        yield pa.RecordBatch.from_arrays([pa.array(qids[total > 0]), pa.array(total[total > 0])], ["qid", "n"])

    return work


def range_join(points: DataFrame, queries: DataFrame, radius: float | str, most: int | None = None) -> DataFrame:
    """qid, id and dist2 of all points within a radius, of all queries or a
    column of theirs; most: at most so many nearest."""
    out = sweep(points.select("id", "x"), queries, within(radius), "qid long, id long, dist2 double", radius if isinstance(radius, str) else None)
    return merge(out, most).select("qid", "id", "dist2") if most else out


# ---------------------------------------------------------------- approximate
def _within(candidates: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest among candidate pairs (qid, id)."""
    pairs = candidates.distinct().join(queries.select("qid", "q"), "qid").join(points.select("id", "x"), "id")
    return merge(pairs.select("qid", "id", distance_column(F.col("q"), F.col("x")).alias("dist2")), k)


def knn_by_keys(points: DataFrame, queries: DataFrame, point_keys: DataFrame, query_keys: DataFrame, k: int, part: int = 1 << 14, block: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest among points that share a (tbl, key) with the query.
    point_keys: id, tbl, key; query_keys: qid, tbl, key. The points and queries of a
    bucket meet in one cell, which sends each query's best k and never all pairs; a
    hot bucket is cut into parts of points and blocks of queries, each pair of which
    is a cell."""
    sizes = point_keys.groupBy("tbl", "key").agg(F.expr(f"cast(ceil(count(*) / {part}) as int)").alias("_p"))
    sizes = sizes.join(query_keys.groupBy("tbl", "key").agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("_b")), ["tbl", "key"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = F.xxhash64("tbl", "key", "_i", "_j").alias("cell")
    there = point_keys.join(sizes, ["tbl", "key"]).select("*", F.pmod(F.xxhash64("id"), F.col("_p")).cast("int").alias("_i"), every("_b").alias("_j"))
    asked = query_keys.join(sizes, ["tbl", "key"]).select("*", every("_p").alias("_i"), F.pmod(F.xxhash64("qid"), F.col("_b")).cast("int").alias("_j"))
    met = meeting(there.select(cell, "id").join(points.select("id", "x"), "id").select("cell", "id", "x"), asked.select(cell, "qid").join(queries.select("qid", "q"), "qid").select("cell", "qid", "q"), nearest(k), "qid long, dist2 double, id long")
    return merge(met, k)


def knn_lsh(points: DataFrame, queries: DataFrame, k: int, hashes: Iterable[Hashes], target: float, checked: int = 64, salt: str = "lsh") -> DataFrame:
    """The k nearest by one table of hashes after the other, lists being merged, until
    on a seeded sample of queries the mean relative excess of distances, a missing
    neighbour counting as one, is at most the target; or no hashes are left."""
    from ..storage import forget, written
    from .sampling import pick_set

    some = pick_set(queries.select("qid", "q"), checked, salt, "qid").persist()
    truth = knn(points, some, k).persist()
    lists, path = None, None
    for h in hashes:
        own = knn_by_keys(points, queries, h.keys(points), h.keys(queries, "qid", "q"), k)
        before = path
        lists, path = written(own if lists is None else merge(lists.unionByName(own).select("qid", "dist2", "id"), k), "lists")
        if before:
            forget(points.sparkSession, before)
        pairs = truth.select("qid", "rank", F.col("dist2").alias("_t")).join(lists.select("qid", "rank", F.col("dist2").alias("_f")), ["qid", "rank"], "left")
        excess = F.when(F.col("_f").isNull(), 1.0).when(F.col("_t") > 1e-12, (F.sqrt("_f") - F.sqrt("_t")) / F.sqrt("_t")).otherwise(F.when(F.col("_f") > 1e-12, 1.0).otherwise(0.0))
        if (pairs.agg(F.avg(excess).alias("e")).first()["e"] or 0.0) <= target:
            break
    return lists


def knn_sampled(points: DataFrame, queries: DataFrame, k: int, leaves: int, rounds: int, salt: str = "leaf") -> DataFrame:
    """The k nearest by leaves around sampled points: a point lies in the leaf of its
    nearest one. A query searches its own leaf and, in each further round, one drawn in
    inverse proportion to squared distance; ties go to the smaller id."""
    from .cluster import MOST_CENTERS
    from .sampling import pick_set

    if leaves > MOST_CENTERS:
        raise ValueError(f"at most {MOST_CENTERS} leaves")
    chosen = pick_set(points.select("id", "x"), leaves, salt).agg(F.collect_list(F.struct("id", "x")).alias("_at"))  # one row, of bounded size

    def leaf(x: str, race) -> Column:
        return F.array_min(F.transform("_at", lambda c: F.struct((distance_column(F.col(x), c["x"]) * race(c)).alias("d"), c["id"].alias("id"))))["id"].cast("string")

    def drawn(c: Column) -> Column:
        u = uniform(F.concat_ws("/", F.col("qid").cast("string"), c["id"].cast("string"), F.col("_r").cast("string")), salt)
        return F.when(F.col("_r") == 0, F.lit(1.0)).otherwise(-F.log(u))

    own = points.select("id", "x").crossJoin(F.broadcast(chosen)).select("id", F.lit(0).alias("tbl"), leaf("x", lambda _: F.lit(1.0)).alias("key"))
    asked = queries.select("qid", "q", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("_r")).crossJoin(F.broadcast(chosen))
    return knn_by_keys(points, queries, own, asked.select("qid", F.lit(0).alias("tbl"), leaf("q", drawn).alias("key")).distinct(), k)


def refine(lists: DataFrame, graph: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours as candidates: lists (qid, id) joined with the
    points' own lists `graph` (id as qid)."""
    more = lists.select("qid", F.col("id").alias("_via")).join(graph.select(F.col("qid").alias("_via"), "id"), "_via").select("qid", "id")
    return _within(more.unionByName(lists.select("qid", "id")), points, queries, k)


def quality(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: hit_rate (share of true neighbours that were found), mean_error
    (mean relative excess of distance by rank) and missed."""
    truth, found = truth.persist(), found.persist()  # both are met twice, by id and by rank
    hits = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    rate = hits.agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("hit_rate"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("missed"))
    by_rank = truth.select("qid", "rank", F.col("dist2").alias("_t")).join(found.select("qid", "rank", F.col("dist2").alias("_f")), ["qid", "rank"])
    excess = by_rank.where("_t > 1e-12").agg(F.avg((F.sqrt("_f") - F.sqrt("_t")) / F.sqrt("_t")).alias("mean_error"))
    return rate.crossJoin(excess)
