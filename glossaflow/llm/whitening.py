"""Whitening by incremental eigendecomposition.

Each partition of the vectors keeps the eigendecomposition of the scatter matrix of what it has read.
A further vector changes that matrix by a rank-one term of the vector's distance from the mean, so
the new eigenvalues are the roots of a secular equation, one between every two old ones, and the new
eigenvectors follow from them.  Where a component of the change or a gap between eigenvalues is
negligible, the pair is deflated: it stays as it is.

Two partitions' spectra are combined the same way, by a rank-one update for each eigenpair of the
second and one for the distance of the means, in groups of partitions, level by level.

Many updates add up rounding errors, so a last pass projects all vectors, centred by the exact mean,
on the basis found, adds up the small matrix of the projections' covariance (Rayleigh-Ritz) and
rotates the basis by its eigenvectors.  The basis is whole, so the result has double precision.

What moves between tasks, and to the driver at the end, is a matrix of dimension x dimension.

Entries c become whole numbers x = floor(scale * c) + offset; sums of x are exact.  The whitened
value of component k is the projection of x - S / n over the square root of its eigenvalue.

Defined results: vectors that are null, empty, hold null or non-finite entries, entries beyond 2**52
after scaling, or have another length than most vectors (of equally common lengths the longest
counts) are left out.  Components whose eigenvalue is zero but for rounding have no whitened value
and are not returned, so a table of equal vectors, of one vector or of none gives no rows.  Equal
eigenvalues leave the choice of their eigenvectors open; it is the same for all rows.  Numbers of
rows may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.llm.common import cut

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Spectra combined in one task.
FAN_IN = 16
_TINY = np.finfo(float).eps
_LARGEST = 2.0**52


def _secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) = 0 for ascending d.

    Returned as the nearer of each root's two poles and the distance from it, which keeps the
    differences d - x accurate.
    """
    n = len(d)
    ends = np.append(d[1:], d[-1] + rho * z2.sum())
    gaps = ends - d
    k = np.arange(n)
    middle = d[:, None] - d[None, :] - gaps[None, :] / 2
    weight = rho * z2[:, None]
    at_middle = 1 + (weight / middle).sum(axis=0)
    # The last root has no pole above it.
    right = (at_middle < 0) & (k < n - 1)
    pole = k + right
    from_pole = d[:, None] - d[pole][None, :]
    low = np.where(right, -gaps / 2, np.where(at_middle < 0, gaps / 2, 0.0))
    high = np.where(right, 0.0, np.where(at_middle < 0, gaps, gaps / 2))
    below = (k[:, None] <= k[None, :]).astype(float)
    # First guess: the other poles' share is that at the middle of the gap.
    up = np.minimum(k + 1, n - 1)
    near, far = weight[k, 0], np.where(k < n - 1, weight[up, 0], 0.0)
    rest = at_middle - near / middle[k, k] - far / np.where(k < n - 1, middle[up, k], 1.0)
    with np.errstate(all="ignore"):
        p, q = rest * gaps + near + far, near * gaps
        root = np.sqrt(np.maximum(p * p - 4 * rest * q, 0))
        left = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * rest))
        left = np.where(k < n - 1, left, near / rest)
        p, q = rest * gaps - near - far, far * gaps
        root = np.sqrt(np.maximum(p * p + 4 * rest * q, 0))
        tau = np.where(right, -np.where(p < 0, 2 * q / (root - p), (p + root) / (2 * rest)), left)
    tau = np.where((tau > low) & (tau < high), tau, (low + high) / 2)
    for _ in range(60):
        away = from_pole - tau
        terms = weight / away
        steep = terms / away
        # Sums over the poles below a root and over those above it.
        psi, dpsi = (below * terms).sum(axis=0), (below * steep).sum(axis=0)
        sums, dphi = terms.sum(axis=0), steep.sum(axis=0) - dpsi
        f, phi = 1 + sums, sums - psi
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        # As near as rounding in f and in the root allows.
        found = np.abs(f) <= _TINY * (8 * (1 - psi + phi) + np.abs(tau) * (dpsi + dphi))
        if found.all():
            break
        # Each half is replaced by a pole of its own and a constant with its value and slope.
        a, b = away[k, k], away[up, k]
        with np.errstate(all="ignore"):
            # c x^2 - p x + q = 0 for the step x; the last root has one pole only.
            c = f - a * dpsi - b * dphi
            p = (a + b) * f - a * b * (dpsi + dphi)
            q = a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            step = np.where(k < n - 1, step, a * f / (f - a * dpsi))
            new = tau + step
        tau = np.where(found, tau, np.where((new >= low) & (new <= high) & (new != 0), new, (low + high) / 2))
    return pole, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors after adding rho * change change^T."""
    z = vectors.T @ change
    size = np.sqrt(z @ z)
    if not size > 0 or not rho > 0:
        return values, vectors
    z, rho = z / size, rho * size * size
    d, small = values, 8 * _TINY * max(abs(values[-1]), abs(values[0]), rho)
    vectors = vectors.copy()
    keep = rho * np.abs(z) > small
    # Of eigenvalues that are equal a rotation leaves one with a share in the change.
    gaps = np.diff(d)
    if (gaps <= small).any():
        start = 0
        for stop in np.append(np.flatnonzero(gaps > small) + 1, len(d)).tolist():
            if stop - start > 1:
                part = z[start:stop]
                length = np.sqrt(part @ part)
                if length > 0:
                    # A reflection that takes the part to the last axis.
                    last = -np.copysign(length, part[-1])
                    mirror = part.copy()
                    mirror[-1] -= last
                    block = vectors[:, start:stop]
                    block -= np.outer(block @ mirror, mirror) * (2 / (mirror @ mirror))
                    z[start:stop] = 0
                    z[stop - 1] = last
                    keep[start:stop] = False
                    keep[stop - 1] = rho * length > small
            start = stop
    active = np.flatnonzero(keep)
    if not len(active):
        return values, vectors
    dk, zk = d[active], z[active]
    pole, tau = _secular_roots(dk, zk * zk, rho)
    # Differences d_i - root_j from the nearer pole.
    apart = (dk[:, None] - dk[pole][None, :]) - tau[None, :]
    # The change for which these roots are exact; its eigenvectors are orthogonal to rounding.
    between = dk[:, None] - dk[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = apart / between
    np.fill_diagonal(ratio, 1.0)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1) * np.diagonal(apart) / rho)) * np.sign(zk)
    turned = exact[:, None] / apart
    turned /= np.sqrt((turned * turned).sum(axis=0))
    vectors[:, active] = vectors[:, active] @ turned
    d = d.copy()
    d[active] = dk[pole] + tau
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, mean and eigendecomposition of the scatter matrix of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dimension: int) -> Spectrum:
        return Spectrum(0, np.zeros(dimension), np.zeros(dimension), np.eye(dimension))

    def add(self, x: np.ndarray) -> None:
        apart = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merged(self, other: Spectrum) -> Spectrum:
        if not self.n or not other.n:
            return self if self.n else other
        values, vectors = self.values, self.vectors
        for size, axis in zip(other.values.tolist(), other.vectors.T):
            values, vectors = rank_one(values, vectors, axis, size)
        apart, n = other.mean - self.mean, self.n + other.n
        values, vectors = rank_one(values, vectors, apart, self.n * other.n / n)
        return Spectrum(n, self.mean + apart * (other.n / n), values, vectors)


def _vectors(rows: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an array of lists count, and their whole numbers without the offset."""
    sizes = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(sizes == dimension)
    with np.errstate(invalid="ignore"):
        x = np.floor(flat[starts[at][:, None] + np.arange(dimension)] * SCALE)
        good = (np.abs(x) <= _LARGEST).all(axis=1)
    return at[good], x[good].astype(np.int64)


def _exact_sums(x: np.ndarray) -> list[int]:
    return [int(s) for s in x.sum(axis=0, dtype=object)] if np.abs(x).max() >= 1 << 40 else x.sum(axis=0).tolist()


_PART = "part long, n long, sums string, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"
_MATRIX = "part long, n long, sums string, cells array<double>"


def _joined(text: str) -> list[int]:
    return [int(s) for s in text.split(",")]


def _folded(parts: DataFrame, schema: str, combine: Callable[[list], tuple]) -> dict | None:
    """The only row left when groups of parts have been combined, level by level; None without parts."""

    def group(frame):
        import pandas as pd

        rows = frame.sort_values("part").to_dict("records")
        names = [c for c in frame.columns if c not in ("part", "group")]
        part = rows[0]["group"]
        return pd.DataFrame([{"part": part, **dict(zip(names, combine(rows)))}])

    while True:
        parts = cut(parts, "parts")
        if parts.count() <= 1:
            row = parts.first()
            return row.asDict() if row else None
        dealt = parts.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        parts = dealt.groupBy("group").applyInPandas(group, schema)


def _merged_spectra(rows: list[dict]) -> tuple:
    dimension = len(rows[0]["mean"])
    spectra = [
        Spectrum(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["eigenvectors"]).reshape(dimension, dimension))
        for r in rows
    ]
    all_of = reduce(Spectrum.merged, spectra)
    sums = [sum(column) for column in zip(*[_joined(r["sums"]) for r in rows])]
    return all_of.n, ",".join(map(str, sums)), all_of.mean.tolist(), all_of.values.tolist(), all_of.vectors.ravel().tolist()


def _added_cells(rows: list[dict]) -> tuple:
    return (
        sum(r["n"] for r in rows),
        "",
        np.sum([np.array(r["cells"]) for r in rows], axis=0).tolist(),
    )


def dimension_of(vectors: DataFrame, vector: str) -> int:
    """The most common length of vectors, 0 without any."""
    sizes = vectors.groupBy(F.size(vector).alias("size")).count().where("size > 0")
    row = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else 0


def spectrum(vectors: DataFrame, vector: str, dimension: int) -> dict | None:
    """Number, exact sums (without offset) and eigendecomposition of all vectors' scatter matrix."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        found, sums = Spectrum.empty(dimension), [0] * dimension
        for batch in batches:
            _, x = _vectors(batch.column(0), dimension)
            if not len(x):
                continue
            sums = [a + b for a, b in zip(sums, _exact_sums(x))]
            for row in x.astype(np.float64):
                found.add(row)
        if found.n:
            part = pyspark.TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "n": [found.n],
                    "sums": [",".join(map(str, sums))],
                    "mean": [found.mean.tolist()],
                    "eigenvalues": [found.values.tolist()],
                    "eigenvectors": [found.vectors.ravel().tolist()],
                }
            )

    return _folded(vectors.select(vector).mapInArrow(of, _PART), _PART, _merged_spectra)


def _moments(vectors: DataFrame, vector: str, dimension: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Of all vectors' projections: sums in the first row, sums of products in the others."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        n, cells = 0, 0
        for batch in batches:
            _, x = _vectors(batch.column(0), dimension)
            if len(x):
                y = project(x)
                n, cells = n + len(y), cells + np.vstack((y.sum(axis=0), y.T @ y))
        if n:
            part = pyspark.TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "n": [n], "sums": [""], "cells": [cells.ravel().tolist()]}
            )

    row = _folded(vectors.select(vector).mapInArrow(of, _MATRIX), _MATRIX, _added_cells)
    width = int((np.sqrt(1 + 4 * len(row["cells"])) - 1) / 2)
    return np.array(row["cells"]).reshape(width + 1, width) / row["n"]


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers, exact."""
    if n * max(int(np.abs(x).max()), 1) >= 1 << 61 or max(map(abs, sums)) >= 1 << 61:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, np.int64)


def _squares(apart: np.ndarray) -> list[int]:
    """Sums of squares of rows, exact."""
    if apart.dtype == object or int(np.abs(apart).max()) ** 2 * apart.shape[1] >= 1 << 62:
        return [sum(int(v) ** 2 for v in row) for row in apart.tolist()]
    return (apart * apart).sum(axis=1).tolist()


@dataclass
class Whitener:
    """What whitening needs of all vectors: axes stand in columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _from_mean(x, self.n, self.sums).astype(np.float64) / self.n

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.eigenvalues))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all vectors that count; None if they span no component."""
    dimension = dimension_of(vectors, vector)
    rough = spectrum(vectors, vector, dimension) if dimension else None
    if not rough:
        return None
    basis = np.array(rough["eigenvectors"]).reshape(dimension, dimension)
    basis, _ = np.linalg.qr(basis)
    n, sums = rough["n"], _joined(rough["sums"])

    def projected(x: np.ndarray) -> np.ndarray:
        return (_from_mean(x, n, sums).astype(np.float64) / n) @ basis

    covariance = _moments(vectors, vector, dimension, projected)[1:]
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    rank = int((values > dimension * _TINY * 16 * max(values[0], 0)).sum()) if values[0] > 0 else 0
    kept = min(rank, components)
    if not kept:
        return None
    found = Whitener(n, sums, values[:kept].copy(), np.ascontiguousarray(axes[:, :kept]), trace)
    moments = _moments(vectors, vector, dimension, found.white)
    mean = moments[0]
    off = moments[1:] - np.outer(mean, mean) - np.eye(kept)
    found.identity_error = float(np.abs(off).max())
    return found


OUTPUT = (
    "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def whiten(vectors: DataFrame, number: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that counts and each component."""
    kind = vectors.schema[number].dataType
    schema = T.StructType([T.StructField(number, kind)] + T._parse_datatype_string(OUTPUT).fields)
    found = fit(vectors, vector, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dimension, width = found.axes.shape[0], len(found.eigenvalues)
    share = found.eigenvalues / found.trace

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _vectors(batch.column(1), dimension)
            if not len(at):
                continue
            rows = pa.array(np.repeat(at, width))
            deviation = pa.array(_squares(_from_mean(x, found.n, found.sums)), pa.decimal128(38, 0))
            size = len(at) * width
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(size, found.n)),
                    deviation.take(pa.array(np.repeat(np.arange(len(at)), width))),
                    pa.array(found.white(x).ravel()),
                    pa.array(np.tile(share, len(at))),
                    pa.array(np.full(size, found.identity_error)),
                ],
                names=schema.names,
            )

    return vectors.select(number, vector).mapInArrow(of, schema)
