"""Kernels as expressions of a squared distance (or, for the polynomial, of an
inner product), both for columns and for numpy blocks.

A kernel of one's own subclasses Kernel: `column` is all that the DataFrame
paths need, `block` what the Arrow paths need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kernel:
    h: float = 1.0
    uses_dot = False
    #: Whether the kernel of two vectors is the product of those of their halves.
    factors = False

    def column(self, s: Column) -> Column:
        raise NotImplementedError

    def block(self, s: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def sql(self, s: str) -> str:
        """The kernel in DuckDB's SQL."""
        raise NotImplementedError


def should_reject(kernel: Kernel, weight: Column, prob: Column, prob_mu: Column, mu: float, delta: float) -> Column:
    """Whether a point of a weight and collision probability adds too much
    variance at a density mu: log_mu(weight prob_mu / prob^2) - 1 < -delta, with
    the kernel's slack."""
    at = math.log(mu)
    slack = math.log(kernel.reject_slack) / at
    return (F.log(weight) + F.log(prob_mu) - 2 * F.log(prob)) / at - 1 < slack - delta


@dataclass(frozen=True)
class Gaussian(Kernel):
    """exp(-d2 / h2); with half, exp(-d2 / (2 h2))."""

    half: bool = False

    @property
    def factors(self):
        return type(self).block is Gaussian.block

    @property
    def _s(self) -> float:
        return (2.0 if self.half else 1.0) * self.h * self.h

    def column(self, s):
        return F.exp(-s / self._s)

    def block(self, s):
        return np.exp(s * (-1.0 / self._s))

    def sql(self, s):
        return f"exp(-({s}) / {self._s!r}::double)"

    # Bounds on the relative variance of estimators at a density mu, and levels.
    def relative_variance(self, mu, delta: float | None = None):
        """Of hashing estimators: e^1.854 / sqrt(mu), or 4 e^1.5 mu^-delta."""
        return math.exp(1.854) / mu**0.5 if delta is None else 4 * math.exp(1.5) * mu**-delta

    #: Slack of should_reject, as a factor in densities.
    reject_slack = 4 * math.exp(1.5)

    def find_level(self, mu: Column, most: int, r: float) -> Column:
        """The level of a density, at most `most`: ceil(log_(1/4) of mu exp(2 / (pi r^2)))."""
        return F.least(F.lit(most), F.ceil(F.log(mu * math.exp(2 / math.pi / r / r)) / math.log(0.25)).cast("int"))

    def inverse(self, p: float) -> float:
        """The distance at which the kernel is p."""
        return self.h * math.sqrt(-math.log(p))

    def dimension_factor(self, d: int) -> float:
        return (2 * math.pi) ** (-d / 2)


@dataclass(frozen=True)
class Exponential(Kernel):
    """exp(-d / h)."""

    def column(self, s):
        return F.exp(-F.sqrt(s) / self.h)

    def block(self, s):
        return np.exp(np.sqrt(s) * (-1.0 / self.h))

    def sql(self, s):
        return f"exp(-sqrt({s}) / {self.h!r}::double)"

    def relative_variance(self, mu, delta: float | None = None):
        """e^1.5 / sqrt(mu), or mu^-delta."""
        return math.exp(1.5) / mu**0.5 if delta is None else mu**-delta

    reject_slack = 1.0

    def find_level(self, mu: Column, most: int, r: float = 1.0) -> Column:
        return F.least(F.lit(most), F.ceil(F.log(mu) / math.log(0.25)).cast("int"))

    def inverse(self, p: float) -> float:
        return -self.h * math.log(p)

    def dimension_factor(self, d: int) -> float:
        """One over the surface of the unit sphere times (d - 1)!."""
        return 1.0 / (2 * math.pi ** (d / 2) / math.gamma(d / 2) * math.gamma(d))


@dataclass(frozen=True)
class Laplace(Kernel):
    """The Green's function of the Laplacian in d dimensions; zero at coinciding points (d >= 2)."""

    d: int = 3
    near = 1e-15

    @property
    def constant(self) -> float:
        return math.gamma(self.d / 2 + 1) / (self.d * (self.d - 2) * math.pi ** (self.d / 2))

    def column(self, s):
        if self.d == 1:
            return F.sqrt(s)
        safe = F.greatest(s, F.lit(self.near))
        value = F.log(F.sqrt(safe)) / (2 * math.pi) if self.d == 2 else F.pow(safe, F.lit((2 - self.d) / 2)) * self.constant
        return F.when(s < self.near, F.lit(0.0)).otherwise(value)

    def block(self, s):
        if self.d == 1:
            return np.sqrt(s)
        value = np.maximum(s, self.near)
        if self.d == 2:
            np.log(value, out=value)
            value *= 0.25 / math.pi  # of the squared distance, so half
        else:
            value = value ** ((2 - self.d) / 2) * self.constant
        value[s < self.near] = 0.0
        return value

    def sql(self, s):
        if self.d == 1:
            return f"sqrt({s})"
        safe = f"greatest({s}, {self.near!r}::double)"
        value = f"ln(sqrt({safe})) / {2 * math.pi!r}::double" if self.d == 2 else f"pow({safe}, {(2 - self.d) / 2!r}::double) * {self.constant!r}::double"
        return f"(case when {s} < {self.near!r}::double then 0.0::double else {value} end)"


@dataclass(frozen=True)
class Matern(Kernel):
    """Matérn of any smoothness nu > 0 at length h; at coinciding points the value
    at z = 200, as good as zero. Smoothness 1/2, 3/2 and 5/2 have closed forms; others
    are 2^(1 - nu) / Gamma(nu) z^nu K_nu(z), with the Bessel function as the integral
    of exp(-z cosh t) cosh(nu t) over t > 0, by the trapezoid rule, which converges
    geometrically."""

    nu: float = 1.5
    near = 1e-15
    #: Step and number of the rule; at the last one exp(-z cosh t) is zero for all z above 1e-7.
    step, steps = 0.125, 192

    def __post_init__(self):
        if self.nu <= 0:
            raise ValueError("nu > 0")

    @property
    def _factor(self) -> float:
        return 2.0 ** (1 - self.nu) / math.gamma(self.nu) * self.step

    def _rule(self) -> list[tuple[float, float]]:
        """(cosh t, weight) of each step, the factor of the kernel included."""
        return [(math.cosh(self.step * j), self._factor * math.cosh(self.nu * self.step * j) * (0.5 if j == 0 else 1.0)) for j in range(self.steps)]

    def _poly(self, z):
        return 1.0 if self.nu == 0.5 else 1.0 + z if self.nu == 1.5 else 1.0 + z + z * z / 3.0

    @property
    def closed(self) -> bool:
        return self.nu in (0.5, 1.5, 2.5)

    def column(self, s):
        z = F.when(s < self.near, F.lit(200.0)).otherwise(F.sqrt(s) * (math.sqrt(2 * self.nu) / self.h))
        if self.closed:
            return F.exp(-z) * self._poly(z)
        rule = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in self._rule()])
        return F.pow(z, F.lit(self.nu)) * F.aggregate(rule, F.lit(0.0), lambda a, r: a + r["w"] * F.exp(-z * r["c"]))

    def block(self, s):
        z = np.where(s < self.near, 200.0, np.sqrt(s) * (math.sqrt(2 * self.nu) / self.h))
        if self.closed:
            return np.exp(-z) * self._poly(z)
        out, low = np.zeros_like(z), float(z.min(initial=200.0))
        for c, w in self._rule():
            if low * c > 745:  # all that follow are zero
                break
            out += w * np.exp(-z * c)
        return z**self.nu * out

    def sql(self, s):
        z = f"(case when {s} < {self.near!r}::double then 200.0::double else sqrt({s}) * {math.sqrt(2 * self.nu) / self.h!r}::double end)"
        if self.closed:
            poly = "1.0::double" if self.nu == 0.5 else f"(1.0::double + {z})" if self.nu == 1.5 else f"(1.0::double + {z} + {z} * {z} / 3.0::double)"
            return f"(exp(-{z}) * {poly})"
        t = f"({self.step!r}::double * j)"
        terms = f"list_transform(range({self.steps}), lambda j: (case when j = 0 then 0.5 else 1.0 end)::double * ((exp({self.nu!r}::double * {t}) + exp({-self.nu!r}::double * {t})) / 2) * exp(-{z} * (exp({t}) + exp(-{t})) / 2))"
        return f"(pow({z}, {self.nu!r}::double) * {self._factor!r}::double * list_sum({terms}))"


@dataclass(frozen=True)
class Polynomial(Kernel):
    """(x . y / h + c) ** p, over inner products."""

    c: float = 1.0
    p: int = 2
    uses_dot = True

    def column(self, s):
        return F.pow(s / self.h + self.c, F.lit(float(self.p)))

    def block(self, s):
        return (s / self.h + self.c) ** self.p

    def sql(self, s):
        return f"pow(({s}) / {self.h!r}::double + {self.c!r}::double, {float(self.p)!r}::double)"
