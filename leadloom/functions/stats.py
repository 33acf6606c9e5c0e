"""Intervals, tests and ratios as column arithmetic over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Rate and Wilson interval; NULL when n is zero."""
    total = F.when(n > 0, n.cast("double"))
    p = successes / total
    spread = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / spread
    margin = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / spread
    return p, centre - margin, centre + margin


def _erfc(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, for x >= 0 (absolute error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return series * F.exp(-x * x)


def two_proportions(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """Two-sided p value of the z test for two proportions; NULL when a side is empty."""
    a = F.when((n1 > 0) & (n2 > 0), n1.cast("double"))
    b = F.when((n1 > 0) & (n2 > 0), n2.cast("double"))
    pooled = (s1 + s2) / (a + b)
    error = F.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b))
    z = F.abs(s1 / a - s2 / b) / F.when(error > 0, error)
    return F.when(error == 0, F.lit(1.0)).otherwise(_erfc(z / F.lit(2.0 ** 0.5)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL when b is zero or NULL."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def uniform(key: Column) -> Column:
    """A number between 0 and 1 that follows from a text alone."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
