"""Special functions over numpy arrays, for K-sized work and vectorised tasks."""

from __future__ import annotations

import math

import numpy as np

from trigrid.functions.special import SHIFT


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + SHIFT
    r = 1 / (y * y)
    out = np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r / 252))
    for i in range(SHIFT):
        out = out - 1 / (x + i)
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + SHIFT
    r = 1 / y
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260))
    for i in range(SHIFT):
        out = out - np.log(x + i)
    return out


def log_softmax(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows less their (weighted) log sum exp."""
    m = x.max(axis=1, keepdims=True)
    e = np.exp(x - m)
    return x - m - np.log((e if weights is None else e * weights).sum(1, keepdims=True))


def standardize(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Columns: (x - mu) / (sd + eps), over finite values; negative variances are raised by the least."""
    ok = np.isfinite(x)
    n = ok.sum(0) + eps
    z = np.where(ok, x, 0)
    mu = z.sum(0) / n
    var = (z * z).sum(0) / n - mu * mu + eps
    var -= min(0.0, var.min(initial=0.0))
    return (x - mu) / (np.sqrt(var) + eps)
