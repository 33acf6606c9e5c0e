"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the spectrum of what it has read: count, mean, eigenvalues and eigenvectors of the centred
scatter. New vectors enter as rank-one updates, each of which solves a secular equation after deflation.
Spectra are combined by the same updates: those of one side, scaled by its eigenvalues, and one for the
distance of the means. A last distributed pass projects all vectors on the combined basis (Rayleigh-Ritz),
so what rounding the updates gathered is gone from values and vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.sources.tables import materialize

#: Units of a vector entry; components returned; partial results that one task combines.
UNITS, COMPONENTS, FAN_IN = 256, 4, 16
#: Vectors that enter together, at least: their triangular factor holds the same scatter in as many rows as dimensions.
TOGETHER = 8192
#: A direction with less of the largest eigenvalue than this has no variance.
NO_VARIANCE = 1e-12
_EPS = np.finfo(float).eps


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q diag(d) q' + v v', for rising d.

    Entries of z = q'v that are nothing, and all but one of those that meet equal eigenvalues (turned onto each other),
    are deflated. For the others the secular equation 1 + sum z_i^2 / (d_i - x) = 0 has one root above
    each d_i; it is bisected as a distance from the nearer pole. z is then computed anew from the roots, which keeps
    the eigenvectors orthogonal.
    """
    z = q.T @ v
    size = float(z @ z)
    tol = 8 * _EPS * max(float(np.abs(d).max(initial=0)), size)
    live = np.abs(z) * np.sqrt(size) > tol
    q = q.copy()
    before = -1
    for i in np.flatnonzero(live):
        if before >= 0 and d[i] - d[before] <= tol:
            r = np.hypot(z[before], z[i])
            c, s = z[i] / r, z[before] / r
            q[:, [before, i]] = q[:, [before, i]] @ np.array([[c, s], [-s, c]])
            z[before], z[i], live[before] = 0.0, r, False
        before = i
    if not live.any():
        return d, q
    dl, zl = d[live], z[live]
    squares = zl * zl
    gap = np.append(np.diff(dl), squares.sum())
    # Distances of all poles from the pole below each root; the root lies nearer to the upper pole where f is negative half way.
    far = dl[None, :] - dl[:, None]
    upper = (1 + (squares / (far - gap[:, None] / 2)).sum(1)) < 0
    upper[-1] = False
    origin = np.where(upper, np.append(dl[1:], 0.0), dl)
    far = dl[None, :] - origin[:, None]
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, np.append(gap[:-1] / 2, gap[-1:]))
    for _ in range(60):
        mid = (low + high) / 2
        with np.errstate(divide="ignore"):
            rises = 1 + (squares / (far - mid[:, None])).sum(1) < 0
        low, high = np.where(rises, mid, low), np.where(rises, high, mid)
    root = (low + high) / 2
    apart = far - root[:, None]  # d_j - x_i, without cancellation
    apart[apart == 0] = np.finfo(float).tiny
    # z_j^2 = prod_i (x_i - d_j) / prod_{i != j} (d_i - d_j), the factors paired so that each quotient is near one.
    poles = dl[:, None] - dl[None, :]
    np.fill_diagonal(poles, 1.0)
    ratio = -apart / poles
    new = np.sqrt(np.abs(np.prod(ratio, axis=0)))
    vectors = np.copysign(new, zl)[:, None] / apart.T
    vectors /= np.linalg.norm(vectors, axis=0)
    values = d.copy()
    values[live] = origin + root
    q[:, live] = q[:, live] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], q[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of a set of vectors."""

    def __init__(self, dims: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def update(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Takes in a set of n vectors with this mean, whose centred scatter is rows' rows."""
        if not n:
            return
        away = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
        for v in (*rows, away):
            if v.any():
                self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, x: np.ndarray) -> None:
        """Takes in vectors: each centred one, or the rows of the triangular factor where these are fewer."""
        mean = x.mean(0)
        centred = x - mean
        self.update(len(x), mean, np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred)

    def merge(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        some = values > 0
        self.update(n, mean, (vectors[:, some] * np.sqrt(values[some])).T)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _vectors(batches: Iterator[pa.RecordBatch], dims: int, least: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(_matrix(batch.column("x"), dims))
        n += batch.num_rows
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


_SPECTRUM = "n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


def _spectrum_row(own: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([own.n]), *(pa.array([x.ravel().tolist()]) for x in (own.mean, own.values, own.vectors))], ["n", "mean", "eigenvalues", "eigenvectors"])


def _combined(parts: DataFrame, count: int, merge: Callable, schema: str) -> tuple:
    """Partial results, one row a task, combined FAN_IN at a time until one is left; that one comes to the driver."""
    while count > 1:
        count = -(-count // FAN_IN)
        parts = parts.repartition(count).mapInArrow(merge, schema)
    return parts.collect()


def spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """The spectrum of the vectors `x`, by updates in each partition and of partitions by each other."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Spectrum(dims)
        for x in _vectors(batches, dims, max(TOGETHER, 64 * dims)):
            made.add(x.astype(float))
        if made.n:
            yield _spectrum_row(made)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Spectrum(dims)
        for batch in batches:
            for r in batch.to_pylist():
                made.merge(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["eigenvectors"]).reshape(dims, dims))
        if made.n:
            yield _spectrum_row(made)

    out = Spectrum(dims)
    for r in _combined(fit.mapInArrow(own, _SPECTRUM), fit.rdd.getNumPartitions(), merged, _SPECTRUM):
        out.merge(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["eigenvectors"]).reshape(dims, dims))
    return out


def _moments(fit: DataFrame, dims: int, centre: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the projections of x - centre on a basis, and of their products."""
    k = basis.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _vectors(batches, dims, TOGETHER):
            y = (x - centre) @ basis
            first += y.sum(0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()])], ["sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_matrix(b.column("sums"), k + k * k).sum(0) for b in batches if b.num_rows), np.zeros(k + k * k))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

    rows = _combined(fit.mapInArrow(summed, "sums array<double>"), fit.rdd.getNumPartitions(), merged, "sums array<double>")
    total = sum((np.array(r["sums"]) for r in rows), np.zeros(k + k * k))
    return total[:k], total[k:].reshape(k, k)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each entry."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for x in _vectors(batches, dims, TOGETHER):
            high, low, n = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * dims)], ["dim", "high", "low", "n"])

    parts = fit.mapInArrow(halves, "dim int, high long, low long, n long")
    rows = parts.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).orderBy("dim").collect()
    return (int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [0] * dims)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component.

    Entries c become whole numbers x = floor(UNITS * c). The components are eigenvectors of the covariance of the distinct
    vectors x (divisor n, their number), the largest eigenvalue first; the entry of largest size of each is positive.
    `deviation` is the sum of (n x - S)^2 with the sums S, exact while it fits a long; `whitened` the projection of x - S/n
    over the root of the eigenvalue; `explained` the share of the trace; `identity_error` the largest entry by which the
    whitened distinct vectors' covariance differs from the identity, from a pass of its own.

    Dropped: vectors that are null or empty or hold null or non-finite entries, and those of another length than most
    distinct vectors have (of equally many the longer). Entries beyond long are its limit. Null or repeated ids: rows as all others.
    A component without variance (one vector, fewer dimensions, vectors in a plane) is left out. Equal eigenvalues: any basis
    of their space. Empty table: no rows. Other columns are not read. What the driver holds has the size of
    dimensions squared.
    """
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * UNITS))
    fine = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    fit = materialize(rows.select("x").distinct(), "vectors")
    sizes = fit.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 1
    fit, rows = fit.filter(F.size("x") == dims), rows.filter(F.size("x") == dims)
    n, sums = _sums(fit, dims)
    centre = np.array([s / max(n, 1) for s in sums])
    basis, _ = np.linalg.qr(spectrum(fit, dims).vectors)
    first, second = _moments(fit, dims, centre, basis)
    small = second / max(n, 1) - np.outer(first, first) / max(n, 1) ** 2
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = [k for k in np.argsort(-values)[:components] if values[k] > NO_VARIANCE * values.max() and values[k] > 0]
    chosen = basis @ turned[:, order]
    chosen *= np.where(chosen[np.abs(chosen).argmax(0), range(len(order))] < 0, -1.0, 1.0) if order else 1.0
    scaled = chosen / np.sqrt(values[order])
    explained = values[order] / values.sum() if order else values[:0]
    first, second = _moments(fit, dims, centre, scaled) if order else (np.zeros(0), np.zeros((0, 0)))
    error = float(np.abs(second / max(n, 1) - np.outer(first, first) / max(n, 1) ** 2 - np.eye(len(order))).max(initial=0))
    k, total = len(order), np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k and batch.num_rows:
                own = _matrix(batch.column("x"), dims)
                with np.errstate(over="ignore"):
                    deviation = ((own * np.int64(n) - total) ** 2).sum(1)
                times = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(times), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)), pa.array([n] * (times * k)),
                    pa.array(np.repeat(deviation, k)), pa.array(((own - centre) @ scaled).ravel()), pa.array(np.tile(explained, times)), pa.array([error] * (times * k))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(projected, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
