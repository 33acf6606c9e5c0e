"""Resampling and regressions against independent computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.functions import similarity
from leadloom.operators import evaluation, regression


def test_binomial_table_and_draws(spark):
    counts = [("a", 40, 13), ("b", 3, 0), ("c", 5, 5), ("d", 20000, 7000)]
    table = evaluation.binomial_table(spark.createDataFrame(counts, "grupo string, n long, x long"))
    got = {(r.grupo, r.k): r.hasta for r in table.collect()}
    total = 0.0
    for k in range(41):
        total += math.comb(40, k) * (13 / 40) ** k * (27 / 40) ** (40 - k)
        assert got["a", k] == pytest.approx(total, abs=1e-12)
    assert {k: v for k, v in got.items() if k[0] in "bc"} == {("b", 0): 1.0, ("c", 5): 1.0}
    assert len([1 for g, _ in got if g == "d"]) < 1300
    rnd = random.Random(1)
    us = [("a", i, rnd.random()) for i in range(300)] + [("a", 300, got["a", 13]), ("a", 301, 0.0), ("a", 302, 1.0), ("b", 0, 0.4)]
    drawn = evaluation.inverse_draws(spark.createDataFrame(us, "grupo string, rep int, u double"), table, ["grupo"]).collect()
    assert len(drawn) == len(us)
    for r in drawn:
        above = [k for (g, k), v in got.items() if g == r.grupo and v > r.u]
        assert r.k == (min(above) if above else max(k for g, k in got if g == r.grupo))


def newton(x, y, penalty=1.0):
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def test_fits_of_several_sets(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, 400), rng.integers(0, 3, 400), rng.normal(5, 2, 400).round(1)]).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.7, 0.3] - 1)))).astype(int)
    part = rng.integers(0, 3, 400)
    rows = [(*map(float, a), int(b), int(c), 1.0) for a, b, c in zip(x, y, part)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, part int, peso double").repartition(3)
    sets = {"all": F.lit(True), **{f"not{k}": F.col("part") != k for k in range(3)}, "none": F.lit(False)}
    got = regression.fit(df, ["a", "b", "c"], "y", sets)
    for name, rows_ in {"all": part >= 0, **{f"not{k}": part != k for k in range(3)}}.items():
        assert np.allclose(got[name], newton(x[rows_], y[rows_]), atol=1e-8)
    assert not got["none"].any()
    grouped = df.groupBy("a", "b", "c", "y", "part").agg(F.sum("peso").alias("peso"))
    assert np.allclose(regression.fit(grouped, ["a", "b", "c"], "y", sets)["not1"], got["not1"], atol=1e-9)


def test_weighted_auc(spark):
    rows = [(0.2, 0, 3), (0.2, 1, 1), (0.7, 1, 2), (0.9, 0, 1), (0.95, 1, 4)]
    whole = [(s, y) for s, y, n in rows for _ in range(n)]
    wins = sum((a > b) + (a == b) / 2 for a, y in whole if y for b, z in whole if not z)
    df = spark.createDataFrame(rows, "s double, y int, w int")
    assert evaluation.auc(df, "s", "y", weight="w").collect()[0].auc == pytest.approx(wins / (7 * 4))


def test_subsequence_of_texts_of_any_length(spark):
    rnd = random.Random(2)
    word = lambda sizes: "".join(rnd.choice("abcdé ") for _ in range(rnd.choice(sizes)))
    rows = [(word([0, 5, 61, 62, 63, 90, 124, 125, 200]), word([0, 3, 62, 63, 70, 130, 186, 187])) for _ in range(60)] + [("a" * 130, "a" * 190), ("a" * 63, "b" * 70)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.lcs(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == plain(r.a, r.b)
