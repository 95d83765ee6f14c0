"""Embedding whitening by LOBPCG.

A component c becomes the long floor(1024 c) + 100000, and sums of these are exact. The covariance V is never formed:
each step multiplies it with a block of vectors in one pass over the rows, which are centred first (whole numbers less
the floor of the mean, then less the fraction), batch by batch, and tasks' blocks are added in a grouped shuffle. The
driver holds such blocks alone: dimensions x (iterate, residuals, previous directions). Rayleigh-Ritz in an orthonormal
basis of these gives the next iterate; products of the whole basis are fresh in every step, so residuals are true ones
and rounding doesn't pile up. Steps go on until the residuals of all wanted components are certified (norm at most
1e-10 of the largest eigenvalue) and don't halve any more, which is where doubles end.

Defined cases: rows whose vector is null or holds a null or a component that isn't finite are dropped, and so are those
with a component that doesn't fit a long (beyond 2^51); vectors of each length are a fit list of their own; a component
whose eigenvalue is zero to double precision (fewer rows or dimensions in use than components) has a null `whitened`
and is left out of `identity_error`, which is null where no component is left; `explained` is null where all rows are
equal; a deviation beyond 64 bits is null; ids may repeat or be null; there are as many components as dimensions, 8 at
most; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import shared, vectors

COMPONENTS, GUARD, SCALE, SHIFT = 8, 8, 1024, 100_000
#: Residual norm of a certified component, as a share of the largest eigenvalue, and the most steps.
CERTIFIED, STEPS = 1e-10, 300
#: |floor(1024 c)| has to be less.
_LARGE = float(1 << 61)


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    return np.floor(vectors.matrix(column, d) * SCALE).astype(np.int64) + SHIFT


@dataclass
class Fit:
    """n rows of d dimensions, the floors of their means and what is left of the sums."""

    n: int
    floors: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floors).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)², which is n (x - floor) - rest, where it fits a long."""
        about = (self.centred(x) ** 2).sum(1) * float(self.n) ** 2
        out: list[int | None] = [None] * len(x)
        fine = np.flatnonzero(about < 2.0**62)
        t = self.n * (x[fine] - self.floors) - self.rest
        for k, v in zip(fine.tolist(), (t * t).sum(1).tolist()):
            out[k] = v
        for k in np.flatnonzero((about >= 2.0**62) & (about < 2.0**63 * 1.01)).tolist():
            v = sum((self.n * (a - int(f)) - int(r)) ** 2 for a, f, r in zip(x[k].tolist(), self.floors, self.rest))
            out[k] = v if v < 1 << 63 else None
        return out


def fitted(rows: DataFrame, d: int) -> Fit:
    """n and S, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            x = whole_numbers(b.column(0), d)
            n += len(x)
            for k, (high, low) in enumerate(zip((x >> 31).sum(0).tolist(), (x & 0x7FFFFFFF).sum(0).tolist())):
                sums[k] += (high << 31) + low
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([Decimal(v) for v in (*sums, n)], pa.decimal128(38, 0))], names=["k", "s"])

    got = {r.k: int(r.s) for r in rows.select("v").mapInArrow(run, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    n = got.get(d, 0)
    sums = [got.get(k, 0) for k in range(d)]
    return Fit(n, np.array([s // max(n, 1) for s in sums], np.int64), np.array([s % max(n, 1) for s in sums], np.int64))


def _added(rows: DataFrame, size: int, each: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of each(batch), size numbers: a task's own sums, merged in one grouped shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += each(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "s"])

    out = np.zeros(size)
    for r in rows.select("v").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r.k] = r.s
    return out


def product(rows: DataFrame, fit: Fit, block: np.ndarray) -> np.ndarray:
    """V times a block of vectors."""
    d = len(block)

    def each(b: pa.RecordBatch) -> np.ndarray:
        c = fit.centred(whole_numbers(b.column(0), d))
        return (c.T @ (c @ block)).ravel()

    return _added(rows, block.size, each).reshape(block.shape) / max(fit.n, 1)


def trace(rows: DataFrame, fit: Fit, d: int) -> float:
    return float(_added(rows, 1, lambda b: np.array([(fit.centred(whole_numbers(b.column(0), d)) ** 2).sum()]))[0]) / max(fit.n, 1)


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of blocks, the first one's columns first; what depends on columns before is left out."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.sqrt((block * block).sum(0))
        new = block[:, size > 0] / size[size > 0]
        for least in (1e-9, 0.5):  # the second time what rounding left of the basis goes
            new = new - basis @ (basis.T @ new)
            if new.shape[1]:
                u, s, _ = np.linalg.svd(new, full_matrices=False)
                new = u[:, s > least]
        basis = np.concatenate([basis, new[:, : len(basis) - basis.shape[1]]], 1)
    return basis


def lobpcg(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns, residual norms) of the wanted largest, times(block) being V block."""
    b = min(d, wanted + guard)
    x, residuals, before = orthonormal(np.random.default_rng(13).normal(size=(d, b))), np.zeros((d, 0)), np.zeros((d, 0))
    best, idle = np.inf, 0
    for _ in range(steps):
        basis = orthonormal(x, residuals, before)
        along = times(basis)
        h = basis.T @ along
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1][:b], turn[:, ::-1][:, :b]
        own = x.shape[1]
        x, before = basis @ turn, basis[:, own:] @ turn[own:]
        residuals = along @ turn - x * values
        norms = np.sqrt((residuals * residuals).sum(0))
        largest = max(float(values[0]), 0.0) if len(values) else 0.0
        worst = float(norms[:wanted].max(initial=0.0))
        best, idle = (worst, 0) if worst < best / 2 else (best, idle + 1)
        if worst <= 4e-16 * largest or worst <= CERTIFIED * largest and idle >= 2:
            return values[:wanted], x[:, :wanted], norms[:wanted]
    raise RuntimeError(f"residuals are not certified: {worst} with eigenvalues from {largest}")


def _whitened(fit: Fit, axes: np.ndarray, values: np.ndarray, able: np.ndarray, explained: list, error: float | None):
    d, k = axes.shape
    scaled = axes / np.where(able, np.sqrt(np.where(able, values, 1.0)), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = whole_numbers(b.column(1), d), len(b)
            w = fit.centred(x) @ scaled
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                pa.array([v for v in fit.deviation(x) for _ in range(k)], pa.int64()), pa.array(w.ravel(), mask=np.tile(~able, m)),
                pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each component of each whole vector."""
    spark = shared.prepared(table.sparkSession)
    rows = vectors.whole(table, id_col, vector_col).where(F.forall("v", lambda x: F.abs(x) * SCALE < F.lit(_LARGE)))
    out = spark.createDataFrame([], _OUT)
    for d in vectors.lengths(rows):
        if not d:
            continue
        same, wanted = vectors.of_length(rows, d), min(components, d)
        fit = fitted(same, d)
        values, axes, _ = lobpcg(lambda block: product(same, fit, block), d, wanted)  # noqa: B023
        total = trace(same, fit, d)
        able = values > max(float(values[0]), 0.0) * d * np.finfo(float).eps
        explained = [max(float(v), 0.0) / total if total else None for v in values]
        error = None
        if able.any():
            scaled, k = (axes / np.sqrt(np.where(able, values, 1.0)))[:, able], int(able.sum())

            def each(b: pa.RecordBatch) -> np.ndarray:
                w = fit.centred(whole_numbers(b.column(0), d)) @ scaled  # noqa: B023
                return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

            sums = _added(same, k * k + k, each) / fit.n
            mean = sums[k * k :]
            error = float(np.abs(sums[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
        out = out.union(same.select("id", "v").mapInArrow(_whitened(fit, axes, values, able, explained, error), _OUT))
    return out.withColumnRenamed("id", id_col)
