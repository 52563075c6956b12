"""Approximate nearest neighbours by inner product: a hierarchical k-means tree
with best-bin-first traversal.

The tree is fitted on a bounded sample of distinct vectors (SAMPLE) and indexes
all of them.  A query walks it through a priority queue: the open node whose
centre has the largest inner product with the query comes next, its children are
queued, and leaves are visited until the calibrated number.  Calibration widens
the visits, over sampled queries and their brute-force neighbours in the sample,
until TARGET of these are found.

Equal vectors are one entry that keeps its smallest ids, one more than k, which
is all that a list of k can need; a vector that many rows share thus costs one
candidate and one query.  Neighbouring leaves share a part up to CHUNK entries, and a
larger leaf is cut into several; a query goes once to each part that holds a leaf it
visits, and neighbouring parts to one task, which sends its best k of each query.

Defined results: vectors that are null, zero, of another size than most, or that
hold null or non-finite components take no part.  Rows that share the query's id
are its own.  Scores are inner products in double precision of the original
vectors; ties go to the smaller id; fewer candidates than k give as many rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Distinct vectors that the tree is fitted on, and their bytes as doubles.
SAMPLE, SAMPLE_BYTES = 65536, 256 << 20
CALIBRATION = 256
TARGET = 0.97
LEAF = 512
BRANCH = 16
CHUNK = 4096
SEED = 7


class Tree:
    """Centres of the children of each inner node; leaves are numbered."""

    def __init__(self, x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = SEED):
        self.centres: list[np.ndarray] = []  # of an inner node's children
        self.children: list[list[int]] = []  # inner node >= 0, leaf: -1 - number
        self.leaves = 0
        self.root = self._grow(x, np.random.default_rng(seed), max(leaf, 2), branch)
        self.visits = self.leaves

    def _grow(self, x: np.ndarray, rng: np.random.Generator, leaf: int, branch: int) -> int:
        if len(x) > leaf:
            centres, own = _kmeans(x, min(branch, -(-len(x) // leaf) + 1), rng)
            if len(centres) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append([])
                self.children[node] = [self._grow(x[own == k], rng, leaf, branch) for k in range(len(centres))]
                return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre from level to level."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            c = self.centres[node]
            near = np.argmax(x[rows] @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def walk(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of best-bin-first traversal."""
        out, heap = [], [(0.0, self.root)]
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-1 - node)
            else:
                for score, child in zip((self.centres[node] @ q).tolist(), self.children[node], strict=True):
                    heapq.heappush(heap, (-score, child))
        return out

    def calibrate(self, x: np.ndarray, k: int, target: float = TARGET, queries: int = CALIBRATION, seed: int = SEED) -> None:
        """The fewest visits that find `target` of the true neighbours of sampled queries among x."""
        if not len(x):
            return
        own, need = self.leaf_of(x), []
        for i in np.random.default_rng(seed).permutation(len(x))[:queries]:
            score = x @ x[i]
            score[i] = -np.inf
            best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
            at = {leaf: n for n, leaf in enumerate(self.walk(x[i], self.leaves), 1)}
            need += [at[leaf] for leaf in own[best].tolist()]
        if need:
            need.sort()
            self.visits = need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums[n > 0] / n[n > 0, None]
    own = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of doubles from stored little-endian floats."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def stored_kind(rows: DataFrame, vector: str) -> str:
    """Vectors are moved as they are stored: 32-bit floats lose nothing, others go as doubles."""
    return "<f4" if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def valid_vectors(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, vec): the vectors that take part, as bytes of stored_kind(); all of one size."""
    kind = stored_kind(rows, vector)
    v = F.col(vector).cast("array<double>")
    good = F.size(v) > 0
    good &= ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0.0)
    own = rows.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    own = own.where(F.size("v") == (sizes["n"] if sizes else 0))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = b.column(1), b.num_rows
            if n:
                x = flat.flatten().to_numpy().reshape(n, -1) + 0.0  # no negative zeros: equal vectors have equal bytes
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], ["id", "vec"])

    return own.mapInArrow(store, "id long, vec binary")


def entries(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """(vec, ids, asked): distinct vectors with their k + 1 smallest ids, and
    whether a query has the vector. A task's rows are merged before the shuffle."""

    def flush(own: dict[bytes, list]) -> pa.RecordBatch:
        ids, asked = [sorted(x[0]) for x in own.values()], [x[1] for x in own.values()]
        return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(asked, pa.bool_())], ["vec", "ids", "asked"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, list] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = own.setdefault(v, [set(), False])
                x[0].add(i)
                x[1] |= i % every == 0
                if len(x[0]) > 4 * (k + 1):
                    x[0] = set(sorted(x[0])[: k + 1])
            if len(own) > CHUNK:
                yield flush(own)
                own = {}
        if own:
            yield flush(own)

    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return vectors.mapInArrow(merge, "vec binary, ids array<long>, asked boolean").groupBy("vec").agg(ids.alias("ids"), F.max("asked").alias("asked"))


def fitted(found: DataFrame, kind: str, k: int, target: float) -> Tree:
    """The tree over a sample of the entries, by a hash of the vectors."""
    total, width = found.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (2 * (width or 1))))  # stored floats are half of doubles at least
    share = min(1.0, 1.2 * most / max(total, 1) + 1e-3)  # so that no task sends more than its part of the sample
    some = found.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else found
    sample = some.orderBy(F.xxhash64("vec"), "vec").limit(most).select("vec").toArrow()
    x = _matrix(sample.column("vec").combine_chunks() if sample.num_rows else pa.array([], pa.binary()), kind)
    tree = Tree(x, max(2, LEAF * len(x) // max(total, 1)))
    tree.calibrate(x, k, target)
    return tree


def parts_of(sizes: dict[int, int], chunk: int = CHUNK) -> dict[int, tuple[int, int]]:
    """Leaf -> (first part, number of parts): leaves in their order share a part up to a chunk; larger ones have their own."""
    out, part, room = {}, -1, 0
    for leaf in sorted(sizes):
        n = -(-sizes[leaf] // chunk)
        if n > 1 or sizes[leaf] > room:
            part, room = part + 1, chunk
        out[leaf] = (part, n)
        part, room = part + n - 1, 0 if n > 1 else room - sizes[leaf]
    return out


def search(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row whose id `every` divides."""
    spark, kind = rows.sparkSession, stored_kind(rows, vector)
    vectors = valid_vectors(rows, id_, vector)
    found = cut(entries(vectors, k, every))
    shared = spark.sparkContext.broadcast(fitted(found, kind, k, target))  # centres of at most SAMPLE vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.leaf_of(_matrix(b.column(0), kind))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(1), b.column(0)], ["leaf", "ids", "vec"])

    placed = found.select("vec", "ids").mapInArrow(assign, "leaf long, ids array<long>, vec binary")
    parts = parts_of({r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()})  # a row a leaf
    where = spark.sparkContext.broadcast(parts)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    beside = max(1, (max((p + m for p, m in parts.values()), default=0)) // (4 * n))  # parts that go to one task together
    schema = "task long, part long, tag int, key long, ids array<long>, leaves array<long>, vec binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def rowed(part: list[int], tag: int, key: list[int], ids: pa.Array, leaves: list[list[int]], vec: pa.Array) -> pa.RecordBatch:
        at = np.array(part, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at // beside), pa.array(at), pa.array(np.full(len(at), tag, np.int32)), pa.array(key, pa.int64()), ids, pa.array(leaves, pa.list_(pa.int64())), vec], names)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, key = b.column(0).to_pylist(), [ids[0] for ids in b.column(1).to_pylist()]
            at = [where.value[x] for x in leaf]
            yield rowed([p + hash(i) % m for (p, m), i in zip(at, key, strict=True)], 0, key, b.column(1), [[x] for x in leaf], b.column(2))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                row, part, leaves = [], [], []
                for i, v in enumerate(_matrix(b.column(0), kind)):
                    own: dict[int, list[int]] = {}
                    for leaf in shared.value.walk(v, shared.value.visits):
                        first, m = where.value.get(leaf, (0, 0))
                        for p in range(first, first + m):
                            own.setdefault(p, []).append(leaf)
                    row += [i] * len(own)
                    part += own
                    leaves += own.values()
                keys = [ids[0] for ids in b.column(1).to_pylist()]
                yield rowed(part, 1, [keys[i] for i in row], pa.nulls(len(row), pa.list_(pa.int64())), leaves, b.column(0).take(pa.array(row, pa.int64())))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, None
        for b in batches:
            parts_, tags = b.column(1).to_numpy(), b.column(2).to_numpy()
            edges = np.flatnonzero((np.diff(parts_) != 0) | (np.diff(tags) != 0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(tags)], strict=True):
                if begin == end:
                    continue
                run = b.slice(begin, end - begin)
                if parts_[begin] != part:
                    part, held = parts_[begin], Part()
                if tags[begin] == 0:
                    held.add(run.column(4).to_pylist(), run.column(5).flatten().to_numpy(), _matrix(run.column(6), kind))
                else:
                    for s in range(0, run.num_rows, 256):
                        block = run.slice(s, 256)
                        yield held.nearest(block.column(3).to_numpy(), _matrix(block.column(6), kind), block.column(5).to_pylist(), k + 1)

    both = placed.mapInArrow(dealt, schema).unionByName(found.where("asked").select("vec", "ids").mapInArrow(route, schema))
    met = both.repartition(n, "task").sortWithinPartitions("part", "tag").mapInArrow(meet, "key long, n double, id long")
    # the rank's limit is applied in each task before the shuffle, too
    top = met.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("n", "id"))).where(F.col("_r") <= k + 1)
    best = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("best"))
    lists = found.where("asked").select("vec", F.element_at("ids", 1).alias("key")).join(best, "key").select("vec", "best")
    asked = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").distinct()
    own = asked.join(lists, "vec").select("query_id", F.slice(F.filter("best", lambda s: s["id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.n")).alias("score"))


class Part:
    """The entries of one part, by leaf."""

    def __init__(self):
        self.ids, self.leaf, self.pieces, self.data = [], [], [], np.empty((0, 0))

    def add(self, ids: list[list[int]], leaf: np.ndarray, x: np.ndarray) -> None:
        self.ids += ids
        self.leaf.append(leaf)
        self.pieces.append(x)

    def nearest(self, keys: np.ndarray, q: np.ndarray, leaves: list[list[int]], k: int) -> pa.RecordBatch:
        """key, n and id: of each query the k nearest ids among its leaves, with
        scores negated. All whose rounded score may reach the k-th are scored anew,
        one way for all, so that ties go by id."""
        if self.pieces:
            self.data, self.leaf, self.pieces = np.concatenate(self.pieces), [np.concatenate(self.leaf)], []
            self.size = float(np.sqrt((self.data**2).sum(axis=1).max()))
        out_key, out_n, out_id = [], [], []
        if self.ids:
            score, leaf = q @ self.data.T, self.leaf[0]
            slack = 8 * (q.shape[1] + 2) * np.finfo(float).eps * np.sqrt((q * q).sum(axis=1)) * self.size
            for i, own in enumerate(leaves):
                at = np.flatnonzero(np.isin(leaf, own))
                s = score[i, at]
                if len(at) > k:
                    at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - slack[i]]
                exact = -(self.data[at] * q[i]).sum(axis=1)
                best = sorted((n, j) for n, r in zip(exact.tolist(), at.tolist(), strict=True) for j in self.ids[r])[:k]
                out_key += [int(keys[i])] * len(best)
                out_n += [n for n, _ in best]
                out_id += [j for _, j in best]
        return pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_n, pa.float64()), pa.array(out_id, pa.int64())], ["key", "n", "id"])
