"""Embedding whitening by spectral divide and conquer.

1. Entries become longs ``floor(256 * c)``.  The fit list holds each distinct vector once.
2. Tasks add up the products of its vectors, centred at the rounded mean; these
   are exact integers, so the covariance is exact up to one rounding of each entry, in any order
   of summation.  Only (dimension)^2 numbers reach the driver.
3. The polar factor U of the shifted covariance V - s I, found by QDWH (dynamically weighted
   Halley steps, each one QR factorisation), has eigenvalues +1 and -1, so
   (U + I) / 2 projects on the eigenvectors with eigenvalues over s.  Bases of both subspaces
   give two smaller symmetric problems; the recursion ends at one dimension, or where all
   eigenvalues are equal to working precision.
4. Mean and leading components are sent to the tasks, which whiten every row.

Results for odd input: rows with a null vector, or with null or non-finite entries,
are dropped; shorter vectors are filled up with zeros; repeated vectors count once in the
fit and are all returned; null vec_ids are returned; a vector of fewer than
``COMPONENTS`` entries has as many components; a component without variance has
``whitened`` null and ``explained`` 0 and is left out of ``identity_error``; components of
equal eigenvalue are any orthonormal basis; an empty table gives no rows; a
``deviation`` that no long holds is null, and ``deviation_exact`` has it up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.vectors import as_long, filled, finite, log2_largest, matrix, roomy
from vantage.session import written

COMPONENTS = 4
EPS = float(np.finfo(float).eps)
#: Shifts tried, in standard deviations of the eigenvalues from their mean.
SHIFTS = (0.0, 0.05, -0.05, 0.15, -0.15, 0.3, -0.3, 0.5, -0.5, 0.7, -0.7, 0.9, -0.9, 0.02, -0.02)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (QDWH; lower bound of singular values: rounding)."""
    n = len(a)
    x, low = a / np.linalg.norm(a), EPS / n
    for _ in range(40):
        t = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + t)
        wa = p + np.sqrt(8 - 4 * t + 8 * (2 - low**2) / (low**2 * p)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS) * np.sqrt(n):
            break
    return x


def split(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces over and under ``shift``; None if it meets an eigenvalue or has one side only."""
    n = len(a)
    shifted = a - shift * np.eye(n)
    if not shifted.any():
        return None
    projector = (polar(shifted) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-10 * n:
        return None
    basis = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(3):  # subspace iteration; the projector's eigenvalues are 0 and 1
        basis, _ = np.linalg.qr(projector @ basis)
    whole, _ = np.linalg.qr(np.hstack([basis, np.random.default_rng(n + 1).standard_normal((n, n - k))]))
    over, under = whole[:, :k], whole[:, k:]
    return (over, under) if np.linalg.norm(under.T @ a @ over) <= 100 * n * EPS * scale else None


def eigen(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric matrix."""
    n = len(a)
    scale = float(np.linalg.norm(a)) if scale is None else scale
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if n == 1 or spread <= 4 * EPS * scale:
        return np.full(n, mean), np.eye(n)
    for t in SHIFTS:
        sides = split(a, mean + t * spread, scale)
        if sides:
            break
    else:
        raise ArithmeticError("no shift separates the eigenvalues")
    values, vectors = [], []
    for basis in sides:
        inner = basis.T @ a @ basis
        e, v = eigen((inner + inner.T) / 2, scale)
        values.append(e)
        vectors.append(basis @ v)
    return np.concatenate(values), np.hstack(vectors)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact sum of the products of rows, as Python integers; float products where all sums stay under 2^53."""
    if 2 * log2_largest(y) + np.log2(max(1, len(y))) < 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


#: Exact sums travel in two decimals, thousands of millions of millions and the rest.
HIGH = 10**18


def totals(rows: DataFrame, fn, spec: str) -> dict[tuple, int]:
    """Total for each key, summed by Spark over what ``fn`` makes of each partition."""
    keys = [c.split()[0] for c in spec.split(", ")]
    got = (rows.mapInArrow(fn, f"{spec}, high decimal(38,0), low decimal(38,0)")
           .groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    return {tuple(r[k] for k in keys): int(r["high"]) * HIGH + int(r["low"]) for r in got}


def exact(values: np.ndarray) -> dict[str, pa.Array]:
    parts = [divmod(int(v), HIGH) for v in values]
    return {side: pa.array([Decimal(p[i]) for p in parts], pa.decimal128(38, 0)) for i, side in enumerate(("high", "low"))}


class Model:
    """Count, sums, rounded mean and covariance of the fit list, and its leading components."""

    def __init__(self, fit: DataFrame, dim: int, components: int = COMPONENTS):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dim + 1, object)  # the last one counts
            for b in batches:
                x = matrix(b.column("x"), dim, np.int64)
                total[:dim] += roomy(x, log2_largest(x) + 20).sum(axis=0)
                total[dim] += len(x)
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim + 1), pa.int32()), **exact(total)})

        got = totals(fit, sums, "at int")
        self.dim, self.n = dim, got.get((dim,), 0)
        self.sums = [got.get((i,), 0) for i in range(dim)]
        n = max(1, self.n)
        self.mean = np.array([s // n for s in self.sums])
        self.rest = np.array([s - n * int(m) for s, m in zip(self.sums, self.mean, strict=True)], object)
        mean = self.mean

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dim, dim), object)
            for b in batches:
                x = matrix(b.column("x"), dim, np.int64)
                total += gram(roomy(x, log2_largest(x) + 1) - mean)
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), **exact(total[i, j])})

        self.covariance = np.zeros((dim, dim))
        for (i, j), total in totals(fit, products, "i int, j int").items():
            v = (n * total - self.rest[i] * self.rest[j]) / (n * n)  # integers, rounded once
            self.covariance[i, j] = self.covariance[j, i] = v
        values, vectors = eigen(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        self.trace = float(np.trace(self.covariance))
        self.varies = self.values > 4 * EPS * dim * self.trace
        # centred entries are (x - mean) - rest / n; one product gives all components
        self.weights = np.where(self.varies, self.vectors / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        self.offset = np.array([r / n for r in self.rest]) @ self.weights

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = roomy(x, log2_largest(x) + 1) - self.mean
        return y.astype(float) @ self.weights - self.offset

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """sum of (n x - S)^2 of each row: n^2 y.y - 2 n y.r + r.r with y = x - mean, r = S - n mean."""
        y = roomy(x, log2_largest(x) + 1) - self.mean
        largest = max(log2_largest(y), log2_largest(self.rest))
        y, r = roomy(y, 2 * largest + np.log2(self.dim)), roomy(self.rest, 2 * largest + np.log2(self.dim))
        yy, yr = (y * y).sum(axis=1).astype(object), (y * r).sum(axis=1).astype(object)
        return self.n**2 * yy - 2 * self.n * yr + int((self.rest * self.rest).sum())


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of (covariance of the whitened fit list - identity), components without variance left out."""
    k = len(model.values)
    sent = fit.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = sent.value.whitened(matrix(b.column("x"), sent.value.dim, np.int64))
            one += w.sum(axis=0)
            two += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k + k * k), pa.int32()), "total": pa.array(np.r_[one, two.ravel()])})

    got = fit.mapInArrow(moments, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    sums = np.array([r["total"] for r in sorted(got, key=lambda r: r["at"])]) / model.n
    gap = np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k))
    return float(gap[np.ix_(model.varies, model.varies)].max(initial=0.0))


OUT = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``OUT``: one row for each kept row and component."""
    rows, dim = filled(finite(embeddings, "vec_id"))
    rows = rows.select("vec_id", F.transform("v", as_long).alias("x"))
    fit = written(rows.select("x").distinct())
    model = Model(fit, dim, components)
    if not model.n:
        return rows.sparkSession.createDataFrame([], OUT)
    gap, k = identity_error(fit, model), len(model.values)
    explained = np.where(model.varies, model.values / max(model.trace, np.finfo(float).tiny), 0.0)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # dimension x dimension numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            x = matrix(b.column("x"), model.dim, np.int64)
            m, dev = len(x), model.deviation(x)
            at = np.repeat(np.arange(m), k)
            plain = pa.array([d if d < 2**63 else None for d in dev], pa.int64())
            wide = pa.array([Decimal(d) if d < 10**38 else None for d in dev], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(pa.array(at)), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                "n": pa.array(np.full(m * k, model.n), pa.int64()), "deviation": plain.take(pa.array(at)),
                "deviation_exact": wide.take(pa.array(at)),
                "whitened": pa.array(model.whitened(x).ravel(), mask=~np.tile(model.varies, m)),
                "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, gap))})

    return rows.mapInArrow(project, OUT)
