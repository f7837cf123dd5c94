"""p-values of the t and F distributions, vectorised in numpy."""
from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isinf(t), 0.0, incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + np.where(np.isinf(t), 0, t) ** 2)))


def f_upper(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def f_two_sided(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    upper = f_upper(f, df1, df2)
    return np.minimum(1.0, 2 * np.minimum(upper, 1 - upper))
