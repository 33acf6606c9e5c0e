"""Logistic regressions of several training sets at once, by Newton steps over one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps at most; a fit has ended when no weight moves further than this.
STEPS, TOLERANCE = 50, 1e-10


def _linear(features: Sequence[str], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c) * float(w) for c, w in zip(features, weights[1:], strict=True)), F.lit(float(weights[0])))


def probability(features: Sequence[str], weights: Sequence[float]) -> Column:
    return 1 / (1 + F.exp(-_linear(features, weights)))


def fit(df: DataFrame, features: Sequence[str], label: str, sets: dict[str, Column], penalty: float = 1.0) -> dict[str, np.ndarray]:
    """Weights (intercept first) of one regression for each training set, a condition on the rows.

    Minimises penalty / 2 times the squared weights without intercept plus the logistic loss. Each step is one pass
    over the rows: the gradient and the products of the features, weighted by p (1 - p), are sums for all sets side by side,
    and only these sums come to the driver. Rows of equal features, label and sets should be grouped before, with
    their number in `peso`. A set without rows has weights of zero.
    """
    names, d = list(sets), len(features) + 1
    x = [F.lit(1.0), *(F.col(c) for c in features)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    ridge = np.diag([0.0] + [penalty] * (d - 1))
    weights = {n: np.zeros(d) for n in names}
    moving = set(names)
    for _ in range(STEPS):
        fits = [F.when(F.coalesce(sets[n], F.lit(False)), F.struct(F.lit(n).alias("m"), probability(features, weights[n]).alias("p"))) for n in sorted(moving)]
        seen = df.select(*(F.col(c).cast("double").alias(c) for c in features), "peso", F.col(label).alias("y"), F.explode(F.array(*fits)).alias("f")).filter("f IS NOT NULL")
        seen = seen.select("f.m", *features, (F.col("peso") * (F.col("f.p") - F.col("y"))).alias("error_"), (F.col("peso") * F.col("f.p") * (1 - F.col("f.p"))).alias("curve_"))
        sums = [F.sum(F.col("error_") * x[i]).alias(f"g{i}") for i in range(d)] + [F.sum(F.col("curve_") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in upper]
        found = {r["m"]: r for r in seen.groupBy("m").agg(*sums).collect()}
        moving &= set(found)
        for n in sorted(moving):
            gradient = np.array([found[n][f"g{i}"] for i in range(d)]) + ridge @ weights[n]
            curve = np.zeros((d, d))
            for i, j in upper:
                curve[i, j] = curve[j, i] = found[n][f"h{i}_{j}"]
            step = np.linalg.lstsq(curve + ridge, gradient, rcond=None)[0]
            weights[n] = weights[n] - step
            if np.abs(step).max() < TOLERANCE:
                moving.discard(n)
        if not moving:
            break
    return weights
