"""Seeded uniforms that depend on a key alone: the same on any engine with md5,
whatever the partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, salt: Column | str | int) -> Column:
    """U(0, 1) from md5(key ':' salt), of 32 bits."""
    key = F.col(key) if isinstance(key, str) else key
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat_ws(":", key.cast("string"), salt.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def uniform_sql(key: str, salt: str | int) -> str:
    """The same in DuckDB's SQL; salt is an SQL expression or a number."""
    return f"((('0x' || substr(md5(concat_ws(':', ({key})::varchar, ({salt})::varchar)), 1, 8))::bigint + 0.5) / 4294967296.0::double)"


def uniform_value(key: object, salt: object) -> float:
    return (int(hashlib.md5(f"{key}:{salt}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def normal(key: Column | str, salt: str) -> Column:
    """N(0, 1) by Box and Muller from two uniforms."""
    return F.sqrt(-2.0 * F.log(uniform(key, f"{salt}a"))) * F.cos(F.lit(6.283185307179586) * uniform(key, f"{salt}b"))


def normal_sql(key: str, salt: str) -> str:
    a, b = f"'{salt}a'", f"'{salt}b'"
    return f"(sqrt(-2.0::double * ln({uniform_sql(key, a)})) * cos(6.283185307179586::double * {uniform_sql(key, b)}))"
