"""Typed configurations, and the pipeline from files to scaled points."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Exponential, Gaussian, Kernel
from ..functions.scalar import scott
from ..functions.vector import scale


@dataclass(frozen=True)
class KdeConfig:
    name: str = ""
    fpath: str = ""
    qpath: str = ""
    exact_path: str = ""
    kernel: str = "gaussian"
    d: int = 0
    n: int = 0
    m: int = 0
    h: float = 1.0
    bw_const: bool = False
    ignore_header: bool = False
    start_col: int = 0
    end_col: int = 0
    eps: float = 0.5
    tau: float = 0.001
    beta: float = 0.5
    sample_ratio: float = 1.0

    @classmethod
    def parse(cls, text: str, scope: str) -> KdeConfig:
        """From `scope { key = "value"; ... }`; unknown keys are passed over."""
        body = re.search(rf"\b{re.escape(scope)}\s*\{{(.*?)\}}", text, re.S)
        if not body:
            raise ValueError(f"no scope {scope}")
        found = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"\s*;', body[1]))
        kinds = {"int": int, "float": float, "bool": lambda v: v.strip().lower() in ("true", "1", "yes"), "str": str}
        return cls(**{f.name: kinds[str(f.type)](found[f.name]) for f in fields(cls) if f.name in found})

    def bandwidth(self, n: int) -> float:
        """h, unless constant times Scott's factor, for the Gaussian times the root of two as well."""
        if self.bw_const:
            return self.h
        return self.h * scott(n, self.d) * (math.sqrt(2.0) if self.kernel == "gaussian" else 1.0)

    def kernel_object(self) -> Kernel:
        return Exponential() if self.kernel.startswith("exp") else Gaussian()


def ingest(spark: SparkSession, config: KdeConfig) -> tuple[DataFrame, DataFrame, DataFrame | None, Kernel]:
    """Points, queries, exact densities and the kernel: both sides scaled by the
    bandwidth, so that the kernel's is one."""
    from ..sources.matrices import read_csv_matrix, read_exact

    first, last = (config.start_col, config.end_col) if config.end_col else (0, config.d - 1)
    x = read_csv_matrix(spark, config.fpath, first, last, config.ignore_header, config.n or None)
    h = config.bandwidth(config.n or x.count())
    points = x.select("id", scale(F.col("x"), h).alias("x"))
    if config.qpath and config.qpath != config.fpath:
        y = read_csv_matrix(spark, config.qpath, first, last, config.ignore_header, config.m or None)
        queries = y.select(F.col("id").alias("qid"), scale(F.col("x"), h).alias("q"))
    else:
        queries = points.select(F.col("id").alias("qid"), F.col("x").alias("q")).where(F.col("qid") < (config.m or 2**62))
    exact = read_exact(spark, config.exact_path) if config.exact_path else None
    return points, queries, exact, config.kernel_object()
