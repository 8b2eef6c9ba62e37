"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

#: Eigenvalues nearer than this share of the largest form a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and the unit reflectors: ``a`` is H1 ... Hk T Hk ... H1 with Hi = I - 2 v v'."""
    a, d = a.astype(float).copy(), len(a)
    reflectors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        norm = np.linalg.norm(v)
        v = v / norm if norm else v
        reflectors.append(v)
        if norm:
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] = a[k, k + 1 :] = 0.0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, v[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, sub: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each shift: the negative pivots of its factorisation."""
    least = max(_EPS * _EPS * max(np.abs(diagonal).max(), np.abs(sub).max(initial=0.0)), np.finfo(float).tiny)
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(int)
    for a, b in zip(diagonal[1:], sub, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = a - shifts - b * b / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, sub: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection until the interval is a few roundings wide."""
    d = len(diagonal)
    reach = np.r_[np.abs(sub), 0.0] + np.r_[0.0, np.abs(sub)]
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    want = d - 1 - np.arange(k)  # the j-th largest has so many below it
    width = 2 * _EPS * max(np.abs(lo).max(), np.abs(hi).max())
    lo, hi = lo - width, hi + width
    while (hi - lo).max() > width and width:
        middle = (lo + hi) / 2
        if ((middle == lo) | (middle == hi)).all():
            break
        more = below(diagonal, sub, middle) > want
        hi, lo = np.where(more, middle, hi), np.where(more, lo, middle)
    return (lo + hi) / 2


def _solve(diagonal: np.ndarray, sub: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift I) z = b by elimination with partial pivoting."""
    d = len(diagonal)
    main, up, up2, z = diagonal - shift, np.r_[sub, 0.0], np.zeros(d), b.copy()
    tiny = _EPS * max(np.abs(diagonal).max(), np.abs(sub).max(initial=0.0), np.finfo(float).tiny / _EPS)
    for i in range(d - 1):
        low = sub[i]
        if abs(main[i]) < abs(low):
            factor = main[i] / low
            main[i], low_up, low_up2 = low, main[i + 1], up[i + 1] if i + 1 < d - 1 else 0.0
            main[i + 1] = up[i] - factor * low_up
            up[i], up2[i] = low_up, low_up2
            if i + 1 < d - 1:
                up[i + 1] = -factor * low_up2
            z[i], z[i + 1] = z[i + 1], z[i] - factor * z[i + 1]
        else:
            factor = low / (main[i] if abs(main[i]) > tiny else np.copysign(tiny, main[i]))
            main[i + 1] -= factor * up[i]
            z[i + 1] -= factor * z[i]
    main = np.where(np.abs(main) < tiny, np.copysign(tiny, main), main)
    for i in reversed(range(d)):
        rest = (up[i] * z[i + 1] if i + 1 < d else 0.0) + (up2[i] * z[i + 2] if i + 2 < d else 0.0)
        z[i] = (z[i] - rest) / main[i]
        if abs(z[i]) > 1e250:  # only the direction counts
            z /= abs(z[i])
    return z


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    A vector's sign makes its largest entry positive. Values of a cluster keep orthogonal vectors, equal values too.
    """
    k = min(k, len(a))
    scale = np.abs(a).max(initial=0.0)
    if not k or not scale:
        return np.zeros(k), np.eye(len(a))[:, :k]
    diagonal, sub, reflectors = tridiagonal(a / scale)
    values = leading_values(diagonal, sub, k)
    top, rng, vectors = np.abs(values).max(), np.random.default_rng(1), np.zeros((len(a), k))
    for j in range(k):
        first = j
        while first and values[first - 1] - values[first] <= CLUSTER * top:
            first -= 1
        z, others = rng.standard_normal(len(a)), vectors[:, first:j]
        shift = values[j] - 4 * _EPS * top * (j - first)
        for _ in range(6):
            z = _solve(diagonal, sub, shift, z / np.linalg.norm(z))
            for _ in range(2):
                z -= others @ (others.T @ z)
        vectors[:, j] = z / np.linalg.norm(z)
    for i, v in reversed(list(enumerate(reflectors))):
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, vectors
