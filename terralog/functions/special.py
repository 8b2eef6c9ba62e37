"""Digamma, incomplete gamma, and the normal law in numpy, for whole arrays."""

from __future__ import annotations

from math import erfc, lgamma

import numpy as np

_lgamma, _erfc = np.vectorize(lgamma, otypes=[float]), np.vectorize(erfc, otypes=[float])


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8, then the asymptotic series."""
    x, out = np.array(x, dtype=float), np.zeros(np.shape(x))
    while (small := x < 8).any():
        out = out - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


#: Shapes from here on take the uniform expansion, whose error falls with the shape.
LARGE = 2e4


def _large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion for large shapes, with its first correction."""
    mu = (x - a) / a
    small = np.abs(mu) < 1e-2
    m = np.where(small, mu, 0.0)
    series = m * m * (1 / 2 - m * (1 / 3 - m * (1 / 4 - m * (1 / 5 - m * (1 / 6 - m / 7)))))
    half = np.where(small, series, mu - np.log1p(np.maximum(mu, -1 + 1e-300)))  # half of eta squared
    eta = np.sign(mu) * np.sqrt(2 * half)
    safe = np.where(np.abs(eta) < 1e-2, 1.0, eta)
    first = np.where(np.abs(eta) < 1e-2, -1 / 3 + eta / 12 - 2 * eta**2 / 135, 1 / np.where(mu == 0, 1.0, mu) - 1 / safe)
    return 0.5 * _erfc(-eta * np.sqrt(a / 2)) - np.exp(-np.minimum(a * half, 700)) / np.sqrt(2 * np.pi * a) * first


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower function below a + 1, term by term until the terms no longer count."""
    term = 1 / a
    total, n = term.copy(), 0
    while True:
        n += 1
        term = term * x / (a + n)
        total = total + term
        if not (term > 1e-17 * total).any():
            return np.exp(-x + a * np.log(x) - _lgamma(a)) * total


def _fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper function above a + 1 by its continued fraction, until the factors are 1."""
    b = x + 1 - a
    c, d = np.full(a.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h, i = d.copy(), 0
    while True:
        i += 1
        an, b = -i * (i - a), b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if not (np.abs(d * c - 1) > 1e-15).any() or i > 10_000:
            return np.exp(-x + a * np.log(x) - _lgamma(a)) * h


def gammainc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above, an expansion for large a."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, 0.0)
    some = x > 0
    for part, f in ((some & (a >= LARGE), _large), (some & (a < LARGE) & (x < a + 1), _series), (some & (a < LARGE) & (x >= a + 1), lambda a, x: 1 - _fraction(a, x))):
        if part.any():
            out[part] = np.clip(f(a[part], x[part]), 0, 1)
    return out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / np.sqrt(2))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """A rational start, then Newton steps."""
    p = np.asarray(p, float)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    z = np.where(p < 0.5, -z, z)
    for _ in range(4):
        z = z - (normal_cdf(z) - p) * np.sqrt(2 * np.pi) * np.exp(np.minimum(z * z / 2, 700))
    return z


def gamma_shape(log_mean_minus_mean_log: np.ndarray) -> np.ndarray:
    """Maximum-likelihood shape: ln a - digamma(a) = s, by Newton steps from Minka's start."""
    s = np.maximum(np.asarray(log_mean_minus_mean_log, float), 1e-12)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(8):
        e = 1e-5 * a
        slope = 1 / a - (digamma(a + e) - digamma(a - e)) / (2 * e)
        a = np.maximum(a - (np.log(a) - digamma(a) - s) / slope, 1e-8)
    return a


def gamma_ppf(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Quantile of the unit gamma law: Newton steps from Wilson and Hilferty's start, kept in a bracket that they narrow."""
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    shape = a.shape
    guess = a * np.maximum(1 - 1 / (9 * a) + normal_ppf(p) / (3 * np.sqrt(a)), 0) ** 3
    tail = np.exp((np.log(p) + _lgamma(a + 1)) / a)  # exact as the quantile goes to 0
    x = np.where((guess > 0) & (a > 0.5), guess, np.minimum(tail, np.maximum(a, 1e-300)))
    x = np.maximum(x, 1e-300).ravel()
    a, p = a.ravel(), p.ravel()
    lo, hi, live = np.zeros(a.shape), np.full(a.shape, np.inf), np.arange(len(a))
    for _ in range(200):
        b, at = a[live], x[live]
        e = gammainc(b, at) - p[live]
        lo[live], hi[live] = np.where(e < 0, at, lo[live]), np.where(e < 0, hi[live], at)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            size = np.log(at)
            step = at - e / np.exp((b - 1) * size - at - _lgamma(b))
        low, high = lo[live], hi[live]
        middle = np.where(np.isfinite(high), (low + high) / 2, 2 * at)
        new = np.where((step > low) & (step < high) & np.isfinite(step), step, middle)
        rounding = 2e-16 * (b * np.abs(size) + at)  # of the exponent in the function, where shapes are large
        done = (np.abs(new - at) <= 1e-13 * at) | (np.abs(e) <= np.minimum(rounding, 1e-12) * p[live])
        x[live[~done]] = new[~done]
        live = live[~done]
        if not len(live):
            break
    return x.reshape(shape)
