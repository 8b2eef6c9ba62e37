"""Whitening of embeddings by their leading principal components (operator 13).

Entries become whole numbers, and each distinct vector counts once. Sums give the exact mean; a second pass over the
distinct vectors adds up centred products a task, so the covariance has the accuracy of doubles whatever the mean is. Its
leading eigenpairs come from ``eigen``. Vectors stay in the cluster: the driver holds numbers that depend on the
dimension alone (sums, covariance, components), and the components are sent to all tasks to project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, eigen

COMPONENTS = 4
#: An entry c becomes floor(SCALE * c).
SCALE = 256
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = 1 << 63


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors as longs; rows left out are those without a vector, with null or non-finite entries or
    entries beyond a long, and those of another length than most rows have (of equally common lengths the longest)."""
    e = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.where(F.col("e").isNotNull() & F.forall("e", lambda c: c.isNotNull() & (F.abs(c * SCALE) < float(_LONG))))
    length = e.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return e.where(F.size("e") == (length["d"] if length else 0)).select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = _matrix(b.column(0))
            high, low = x >> 32, x & 0xFFFFFFFF  # halves, so that no sum of a batch leaves 64 bits
            part = [(int(h) << 32) + int(w) for h, w in zip(high.sum(0), low.sum(0), strict=True)]
            n, total = n + len(x), part if total is None else [a + c for a, c in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.decimal128(38))], ["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def products(fit: DataFrame, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Mean product of each pair of dimensions of the centred rows, or of their projections, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            z = _matrix(b.column(0)) - mean
            z = z if project is None else z @ project
            total, n = z.T @ z + (0.0 if total is None else total), n + len(z)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]), pa.array(np.full(len(i), n))], ["i", "j", "s", "n"])

    d = len(mean) if project is None else project.shape[1]
    out = np.zeros((d, d))
    for r in fit.mapInArrow(run, "i int, j int, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it does not fit a long."""
    size = max(int(np.abs(x.astype(float)).max(initial=0.0)) + 1, max(map(abs, total), default=0) // max(n, 1) + 1)
    if x.shape[1] * (2 * n * size) ** 2 < _LONG:
        d = n * x - np.array(total, dtype=np.int64)
        return (d * d).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
    return [v if v < _LONG else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each row of ``quantised`` and component.

    The fit list is each distinct quantised vector once: n of them with sums S. Components are unit eigenvectors of its
    covariance (divisor n), numbered from 1 by falling eigenvalue, their largest entry positive; those whose eigenvalue is
    0 to the accuracy of doubles are left out, so equal rows, a single row and an empty table give no rows. ``explained``
    is the eigenvalue's share of the trace; ``identity_error`` the largest entry of the whitened fit list's covariance less
    the identity. A deviation that does not fit a long is null. Repeated rows and null ids give rows of their own.
    """
    rows = quantised(vectors)
    fit = base.stored(rows.select("x").distinct())
    n, total = sums(fit)
    mean = np.array([s / n for s in total])
    v = products(fit, mean)
    trace = float(np.trace(v))
    values, vectors_ = eigen.leading(v, components)
    kept = values > len(v) * np.finfo(float).eps * trace
    values, project = values[kept], vectors_[:, kept] / np.sqrt(values[kept])
    error = float(np.abs(products(fit, mean, project) - np.eye(len(values))).max(initial=0.0))
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not k:
                continue
            x = _matrix(b.column(1))
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(x, n, total), pa.int64()).take(each),
                pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)
