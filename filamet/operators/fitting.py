"""Gaussian centre of a binned distribution, fitted per group over its histogram rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STEPS = 500  # far more than a fit takes; without convergence the start values stand


def fit_gaussian(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Levenberg-Marquardt for ``a * exp(-((x - b) / c)**2)``; the start values where it fails."""
    if len(x) < 3 or y.max() <= 0:
        return None, None, None
    i = int(np.argmax(y))
    start = np.array([y[i], x[i], max(float(np.std(x)), float(np.ptp(x)) / 4, np.finfo(float).eps)])
    p, damp = start.copy(), 1e-3

    def residual(q: np.ndarray) -> np.ndarray:
        return y - q[0] * np.exp(-(((x - q[1]) / q[2]) ** 2))

    r = residual(p)
    for _ in range(STEPS):
        z = (x - p[1]) / p[2]
        g = np.exp(-(z**2))
        jac = np.column_stack((g, 2 * p[0] * g * z / p[2], 2 * p[0] * g * z**2 / p[2]))
        normal, right = jac.T @ jac, jac.T @ r
        try:
            move = np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-300)), right)
        except np.linalg.LinAlgError:
            return float(start[0]), float(start[1]), float(start[2])
        trial = p + move
        rt = residual(trial) if trial[2] > 0 else np.full_like(r, np.inf)
        if np.isfinite(rt).all() and rt @ rt <= r @ r:
            done = r @ r - rt @ rt <= 1e-14 * max(r @ r, 1e-300)
            p, r, damp = trial, rt, damp / 4
            if done:
                break
        else:
            damp *= 8
            if damp > 1e12:  # no smaller residual in any direction: a minimum
                break
    else:
        return float(start[0]), float(start[1]), float(start[2])
    if not np.isfinite(p).all():
        return float(start[0]), float(start[1]), float(start[2])
    return float(p[0]), float(p[1]), float(abs(p[2]))


def fit_histograms(hist: DataFrame, keys: Sequence[str], *, center: str = "center", count: str = "n") -> DataFrame:
    """Fit every group's histogram.  A group holds at most its number of bins, never raw samples."""
    keys = list(keys)
    fields = ", ".join(f"`{k}` {hist.schema[k].dataType.simpleString()}" for k in keys)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(center)
        a, b, c = fit_gaussian(part[center].to_numpy(float), part[count].to_numpy(float))
        return pd.DataFrame([{**{k: part[k].iloc[0] for k in keys}, "a1": a, "b1": b, "c1": c}])

    return hist.select(*keys, center, count).groupBy(*keys).applyInPandas(fit, f"{fields}, a1 double, b1 double, c1 double")
