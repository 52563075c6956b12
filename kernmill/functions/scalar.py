"""Scalar formulas: error function, collision probabilities, hash parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of formula 7.1.26 in Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """By that formula; absolute error up to 1.5e-7."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def erf_sql(x: str) -> str:
    t = f"(1.0::double / (1.0::double + {ERF_P} * abs({x})))"
    poly = "0.0::double"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})::double) * {t})"
    return f"(sign({x}) * (1.0::double - {poly} * exp(-({x}) * ({x}))))"


def collision(distance: Column, width: float | Column, power: int | Column, exact: bool = False, near: float = 0.0) -> Column:
    """Probability that a distance collides under `power` hashes of a width. By
    default with erf(1/c), which estimates have always used; exact: with the
    true erf(1/(sqrt(2) c)). At distance zero 1, and at less than `near` widths."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    c = distance / width
    c = F.when(c < 1e-12, F.lit(1e-12)).otherwise(c)
    inner = 1.0 / (c * math.sqrt(2.0)) if exact else 1.0 / c
    p = erf(inner) - F.lit(math.sqrt(2.0 / math.pi)) * c * (1.0 - F.exp(-1.0 / (2.0 * c * c)))
    return F.when((distance <= 1e-12) | (c < near), F.lit(1.0)).otherwise(F.pow(F.greatest(p, F.lit(0.0)), power))


def collision_sql(distance: str, width: str, power: str, exact: bool = False, near: float = 0.0) -> str:
    c = f"greatest(({distance}) / ({width})::double, 1e-12::double)"
    inner = f"(1.0::double / ({c} * {math.sqrt(2.0)!r}::double))" if exact else f"(1.0::double / {c})"
    p = f"({erf_sql(inner)} - {math.sqrt(2.0 / math.pi)!r}::double * {c} * (1.0::double - exp(-1.0::double / (2.0::double * {c} * {c}))))"
    return f"(case when ({distance}) <= 1e-12::double or {c} < {near!r}::double then 1.0::double else pow(greatest({p}, 0.0::double), {power}) end)"


def scott(n: int, d: int) -> float:
    """Scott's factor n ** (-1 / (d + 4))."""
    return n ** (-1.0 / (d + 4))


def hash_power(diameter: float, beta: float = 0.5) -> int:
    """Hashes in a table for data of a diameter."""
    return min(3 * math.ceil((beta * diameter) ** 2), math.ceil(beta * diameter * math.sqrt(math.pi / 2)))


def hash_power_of_density(mu: float, beta: float = 0.5) -> int:
    return math.ceil(math.sqrt(2 * math.pi) * beta * math.log(1 / mu))


def hash_power_of_width(width: float, beta: float = 0.5) -> int:
    return math.ceil(beta * math.sqrt(math.pi / 2) * width)


def hash_width(power: int, beta: float = 0.5) -> float:
    return power / (beta * math.sqrt(math.pi / 2))
