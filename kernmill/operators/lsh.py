"""Locality-sensitive hashing: keys, bucket tables, and trees of projections.

Hash functions are rows (level, tbl, j, g, b); their normals and uniforms come
from the seeded generator, so a table can be built anywhere, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from .sweep import matrix


@dataclass(frozen=True)
class Hashes:
    """Projections g (tables x power x d), offsets b in [0, 1), and a width."""

    g: np.ndarray
    b: np.ndarray
    width: float

    @classmethod
    def seeded(cls, tables: int, power: int, d: int, width: float, seed: int = 1) -> Hashes:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((tables, power, d)).round(6), rng.random((tables, power)).round(6), width)

    def keys(self, points: DataFrame, id_: str = "id", x: str = "x") -> DataFrame:
        """(id, tbl, key): key is the text of the ceiled projections, comma-joined; never folded to fewer bits."""
        tables, power, d = self.g.shape
        if not power:  # no hash: one bucket a table
            return points.select(F.col(id_).cast("long").alias(id_), F.explode(F.array(*[F.lit(t) for t in range(tables)])).alias("tbl"), F.lit("").alias("key"))
        flat, width, b = self.g.reshape(tables * power, d), self.width, self.b.reshape(-1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                h = np.ceil(matrix(batch.column(1)) @ flat.T / width + b).astype(np.int64).reshape(-1, tables, power)
                keys = [",".join(map(str, row)) for row in h.reshape(-1, power).tolist()]
                ids = np.repeat(batch.column(0).to_numpy(), tables)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(keys)], [id_, "tbl", "key"])

        return points.select(id_, x).mapInArrow(run, f"{id_} long, tbl int, key string")

    def sql(self, source: str, id_: str = "id", x: str = "x") -> str:
        """The same rows in DuckDB's SQL, from a relation with (id, x)."""
        if not self.g.shape[1]:
            return f"select {id_}, tbl::int as tbl, '' as key from {source}, range({self.g.shape[0]}) t(tbl)"
        rows = ", ".join(f"({t}, {j}, {self.g[t, j].tolist()}::double[], {float(self.b[t, j])!r}::double)" for t in range(self.g.shape[0]) for j in range(self.g.shape[1]))
        return (
            f"select {id_}, tbl::int as tbl, string_agg(h::varchar, ',' order by j) as key from (select {id_}, tbl, j, "
            f"ceil(list_dot_product({x}, g) / {self.width!r}::double + b)::bigint as h from {source}, (values {rows}) as f(tbl, j, g, b)) group by all"
        )


def scale_index(w: Column, low: float, step: float) -> Column:
    """The scale of a weight: floor(ln(w / low) / ln(step))."""
    return F.floor(F.log(w / low) / F.log(F.lit(step))).cast("int")


def scale_step(low: float, high: float, scales: int) -> float:
    return (high / low) ** (1.0 / scales) * 1.1


def buckets(keyed: DataFrame, weight: str | None = None, scale: str | None = None, salt: str = "rep") -> DataFrame:
    """A row for each (tbl, key and scale): cnt, wsum and rep_id, one member drawn
    uniformly or, with a weight, in proportion to it.

    The draw is a race of exponentials by seeded uniforms: the smallest
    -ln(u) / w wins. It is a minimum, so tasks pre-aggregate and parts merge.
    """
    keys = ["tbl", "key", *([scale] if scale else [])]
    u = uniform(F.concat_ws("/", F.col("id").cast("string"), F.col("tbl").cast("string")), salt)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    race = F.struct((-F.log(u) / w).alias("t"), F.col("id").alias("id"))
    return keyed.groupBy(*keys).agg(F.count("*").alias("cnt"), F.sum(w).alias("wsum"), F.min(race)["id"].alias("rep_id"))


def floor_keys(points: DataFrame, a: np.ndarray, b: np.ndarray, radius: float, multipliers: np.ndarray, modulus: int = 2**32 - 5) -> DataFrame:
    """(id, key): floor hashes of width 4 radius, folded by multipliers modulo a prime."""
    width = 4.0 * radius
    h = [F.floor((F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in row]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)) / width + float(off)) for row, off in zip(a, b, strict=True)]
    key = sum((m * int(r) for m, r in zip(h, multipliers, strict=True)), F.lit(0))
    return points.select("id", F.pmod(key.cast("long"), F.lit(modulus)).alias("key"))
