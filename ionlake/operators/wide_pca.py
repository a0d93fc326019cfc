"""Principal components of rows with very many columns (I8, I9), without their covariance.

A block Krylov method: the covariance is only ever multiplied with a few vectors, in one pass over the
rows that adds up, for every column, as many numbers as there are vectors. What the driver holds is the width times
``BASIS`` numbers. Rows stay sparse: a row is the numbers of its columns and their values, and the mean is taken
off the products, not off the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that a pass multiplies beyond those asked for, vectors of the basis before it is cut back, passes at most, and the residual to reach relative to the largest variance.
EXTRA, BASIS, PASSES, ENOUGH = 8, 160, 120, 1e-11


def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of all cells of a batch whose last columns are ``at`` and ``x``; null cells are left out."""
    at, x = batch.column("at"), batch.column("x")
    size = np.diff(at.offsets.to_numpy())
    row, column = np.repeat(np.arange(len(batch)), size), at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    value = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(value)
    return row[known], column[known], value[known]


def sum_by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by group, for groups 0 to n-1."""
    return np.stack([np.bincount(group, v, n) for v in values.T], axis=1) if values.shape[1] else np.zeros((n, 0))


def _gather(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of a matrix of ``shape``, whose rows ``run`` yields as (i, x...)."""
    schema = "i long, " + ", ".join(f"x{j} double" for j in range(shape[1]))
    found = rows.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(shape[1])]).toArrow()
    out = np.zeros(shape)
    out[found.column("i").to_numpy()] = np.stack([found.column(f"x{j}").to_numpy() for j in range(shape[1])], axis=1)
    return out


def _rows_of(total: np.ndarray) -> pa.RecordBatch:
    have = np.flatnonzero(total.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(have), *(pa.array(c) for c in total[have].T)], ["i", *(f"x{j}" for j in range(total.shape[1]))])


def _moments(rows: DataFrame, width: int) -> tuple[int, np.ndarray, float]:
    """Rows, mean of each column, and the sum of all columns' variances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, 2))
        for batch in batches:
            _, column, value = cells_of(batch)
            total[:width] += sum_by(column, np.stack([value, np.zeros(len(value))], axis=1), width)
            total[width] += len(batch), 0
        yield _rows_of(total)

    total = _gather(rows, run, (width + 1, 2))
    n, mean = int(total[width, 0]), total[:width, 0] / max(total[width, 0], 1)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1, 1))
        for batch in batches:
            _, column, value = cells_of(batch)
            # Cells that a sparse row leaves out are as far from the mean as the mean is from 0.
            out += ((value - mean[column]) ** 2 - mean[column] ** 2).sum() + len(batch) * (mean**2).sum()
        yield _rows_of(out)

    return n, mean, float(_gather(rows, squares, (1, 1))[0, 0]) / max(n - 1, 1)


def _times(rows: DataFrame, vectors: np.ndarray, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance times ``vectors``."""
    width, r = vectors.shape
    shift = mean @ vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, r))
        for batch in batches:
            row, column, value = cells_of(batch)
            y = sum_by(row, vectors[column] * value[:, None], len(batch)) - shift
            total[:width] += sum_by(column, y[row] * value[:, None], width)
            total[width] += y.sum(0)
        yield _rows_of(total)

    total = _gather(rows, run, (width + 1, r))
    return (total[:width] - np.outer(mean, total[width])) / max(n - 1, 1)


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to the span of ``basis``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    found, size, _ = np.linalg.svd(block, full_matrices=False)
    found = found[:, size > 1e-9 * size.max(initial=0)]
    return np.linalg.qr(found - basis @ (basis.T @ found))[0]


def wide_components(rows: DataFrame, width: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, components as columns, their variances, sum of all variances) of written rows with ``at`` and ``x``.

    ``rows`` are read once for each pass, so they should be a written table.
    """
    n, mean, total = _moments(rows, width)
    k = min(k, width, n)
    r = min(k + EXTRA, width)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, r)))[0]
    vectors, values = np.zeros((width, k)), np.zeros(k)
    for _ in range(PASSES):
        new = _times(rows, block, mean, n)
        basis, images = np.hstack([basis, block]), np.hstack([images, new])
        small = basis.T @ images
        found, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-found)
        found, turn = found[order], turn[:, order]
        values, vectors = np.maximum(found[:k], 0), basis @ turn[:, :k]
        off = np.linalg.norm(images @ turn[:, :k] - vectors * found[:k], axis=0)
        if (off <= ENOUGH * max(found[0], 1e-300)).all() or basis.shape[1] >= width:
            break
        block = _new_directions(images @ turn[:, :r] - (basis @ turn[:, :r]) * found[:r], basis)[:, : width - basis.shape[1]]
        if not block.shape[1]:
            break
        if basis.shape[1] + block.shape[1] > BASIS:  # the best of the basis is what is kept of it
            keep = turn[:, : 3 * r]
            basis, images = basis @ keep, images @ keep
    return mean, vectors, values, total
