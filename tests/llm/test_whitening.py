import math
import random

import numpy as np
import pytest

from leadloom.llm import whitening as wh


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_update(seed):
    rng = np.random.default_rng(seed)
    k = 12
    q, _ = np.linalg.qr(rng.normal(size=(k, k)))
    d = np.sort(rng.random(k)) if seed < 3 else np.sort(np.repeat(rng.random(k // 3), 3))
    v = rng.normal(size=k) if seed % 3 else q[:, 2] * 3 + (q[:, 7] * 1e-9 if seed else 0)
    values, vectors = wh.rank_one(d, q, v)
    whole = q @ np.diag(d) @ q.T + np.outer(v, v)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, whole, atol=1e-11)
    assert np.allclose(values, np.linalg.eigvalsh(whole), atol=1e-11)


def test_spectra_combine():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 5
    a, b = wh.Spectrum(7), wh.Spectrum(7)
    for part in (x[:4], x[4:5], x[5:120]):
        a.add(part)
    b.add(x[120:])
    a.merge(b.n, b.mean, b.values, b.vectors)
    centred = x - x.mean(0)
    assert a.n == 300 and np.allclose(a.mean, x.mean(0))
    assert np.allclose(a.vectors @ np.diag(a.values) @ a.vectors.T, centred.T @ centred, rtol=1e-10)


def brute(rows, k=4):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = np.array([[float(c - t / n) for c, t in zip(x, s)] for x in fit])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    out = []
    for i, x in good:
        dev = int(sum((n * c - t) ** 2 for c, t in zip(x, s)))
        w = np.array([float(c - t / n) for c, t in zip(x, s)]) @ q[:, order] / np.sqrt(e[order])
        out += [(i, j + 1, n, dev, abs(w[j]), e[order[j]] / e.sum()) for j in range(len(order))]
    return out


def rows_of(seed, n=400, dims=10):
    rnd = random.Random(seed)
    mix = [[rnd.gauss(0, 1) / (1 + j) for _ in range(dims)] for j in range(dims)]
    rows = []
    for i in range(n):
        z = [rnd.gauss(0, 1) for _ in range(dims)]
        rows.append((i, [sum(a * m[c] for a, m in zip(z, mix)) + c for c in range(dims)]))
    return rows


def test_matches_brute_force(spark):
    rows = rows_of(4)
    rows += [(1000, rows[0][1]), (None, rows[1][1]), (5, rows[2][1])]
    bad = [(2000, None), (2001, [1.0] * 9 + [None]), (2002, [float("nan")] * 10), (2003, [float("inf")] + [0.0] * 9), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as n").repartition(20)
    got = wh.whiten(df).collect()
    key = lambda r: (repr(r[0]), r[3], r[1], r[4])
    mine = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert np.allclose([m[4:] for m in mine], [w[4:] for w in want], rtol=1e-7, atol=1e-9)
    assert max(r.identity_error for r in got) < 1e-10


def test_signs_and_uncorrelated(spark):
    """Components have one sign for all rows: whitened columns are uncorrelated with variance one."""
    df = spark.createDataFrame(rows_of(8, 300, 6), "vec_id long, embedding array<double>").repartition(3)
    got = {(r.vec_id, r.component): r.whitened for r in wh.whiten(df).collect()}
    w = np.array([[got[i, c] for c in range(1, 5)] for i in range(300)])
    assert np.allclose(w.T @ w / 300, np.eye(4), atol=1e-9)


def test_little_or_no_variance(spark):
    made = lambda rows: wh.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<float>")).collect()
    assert made([]) == [] and made([("a", None)]) == []
    assert made([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]) == []
    line = made([("a", [1.0, 1.0]), ("b", [2.0, 2.0]), ("c", [3.0, 3.0])])
    assert [(r.vec_id, r.component, r.n) for r in sorted(line)] == [("a", 1, 3), ("b", 1, 3), ("c", 1, 3)]
    assert np.allclose(sorted(r.whitened for r in line), [-math.sqrt(1.5), 0, math.sqrt(1.5)]) and all(abs(r.explained - 1) < 1e-12 for r in line)
