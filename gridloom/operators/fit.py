"""Curve fits per group: bounded Gaussian rocking curves and radial backgrounds, by grouped Arrow batches.

A group is one curve of a few dozen points, so it always fits a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROCKING = "status string, theta0 double, fwhm double, amplitude double, background double, r2 double"


def levenberg(model, start: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Bounded Levenberg-Marquardt with a forward-difference Jacobian."""
    p, damp = np.clip(start, low, high), 1e-2
    at, normal, slope = model(p), None, None
    cost = float(((at - y) ** 2).sum())
    for _ in range(rounds):
        if normal is None:  # a refused move leaves the place, and so its Jacobian, as they were
            step = np.maximum(1e-7, 1e-6 * np.abs(p))
            jac = np.stack([(model(p + step * (np.arange(len(p)) == k)) - at) / step[k] for k in range(len(p))], axis=1)
            normal, slope = jac.T @ jac, jac.T @ (y - at)
        move = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), slope, rcond=None)[0]
        new = np.clip(p + move, low, high)
        new_at = model(new)
        new_cost = float(((new_at - y) ** 2).sum())
        if new_cost < cost:
            if cost - new_cost < 1e-14 * max(cost, 1e-30):
                return new
            p, at, cost, damp, normal = new, new_at, new_cost, damp * 0.3, None
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p


def gaussian_curve(t: np.ndarray):
    return lambda p: p[3] + p[2] * np.exp(-4 * math.log(2) * ((t - p[0]) / p[1]) ** 2)


def fit_rocking(t: np.ndarray, y: np.ndarray, least: int = 4, least_r2: float = 0.5) -> tuple:
    """(status, theta0, fwhm, amplitude, background, r2) of one curve.

    empty: no points; too_sparse: under `least`; monotonic: the maximum lies at an end;
    poor_fit: r2 below least_r2; else fit. Without a fit theta0 is the place of the maximum.
    """
    nothing = (None,) * 4
    if not len(t):
        return ("empty", None, *nothing)
    order = np.argsort(t, kind="stable")
    t, y = t[order], y[order]
    top = float(t[int(np.argmax(y))])
    if len(t) < least:
        return ("too_sparse", top, *nothing)
    if int(np.argmax(y)) in (0, len(y) - 1) and (np.diff(y) >= 0).all() | (np.diff(y) <= 0).all():
        return ("monotonic", top, *nothing)
    span = float(t[-1] - t[0]) or 1.0
    low = np.array([t[0], span / 50, 0.0, min(0.0, float(y.min()))])
    high = np.array([t[-1], 4 * span, 10 * max(1e-9, float(np.ptp(y))), float(y.max())])
    p = levenberg(gaussian_curve(t), np.array([top, span / 3, float(np.ptp(y)), float(y.min())]), low, high, y)
    left = float(((y - gaussian_curve(t)(p)) ** 2).sum())
    r2 = 1 - left / max(1e-30, float(((y - y.mean()) ** 2).sum()))
    return ("fit" if r2 >= least_r2 else "poor_fit", *map(float, p), r2)


def fit_curves(curves: DataFrame, key: str) -> DataFrame:
    """A rocking fit for each curve (key, theta, intensity)."""
    kind = dict(curves.dtypes)[key]

    def run(group, pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf.dropna(subset=["theta", "intensity"])
        row = fit_rocking(good.theta.to_numpy(dtype=float), good.intensity.to_numpy(dtype=float))
        return pd.DataFrame([(group[0], *row)], columns=[key, "status", "theta0", "fwhm", "amplitude", "background", "r2"])

    return curves.select(key, "theta", "intensity").groupBy(key).applyInPandas(run, f"{key} {kind}, {ROCKING}")


def low_pass(profile: np.ndarray, cutoffs: tuple[int, ...] = (2, 4, 8, 16, 32)) -> tuple[np.ndarray, int]:
    """The profile's low Fourier terms, with the cut-off of least penalised error."""
    spectrum, n = np.fft.rfft(profile), len(profile)
    best = None
    for c in cutoffs:
        kept = np.where(np.arange(len(spectrum)) < c, spectrum, 0)
        back = np.fft.irfft(kept, n)
        error = math.sqrt(float(((profile - back) ** 2).mean())) * (1 + c / n)
        if best is None or error < best[0]:
            best = (error, back, c)
    return best[1], best[2]


def fit_backgrounds(profiles: DataFrame, key: str = "gi") -> DataFrame:
    """Background of each radial profile (key, ring, mean): key, ring, background, cutoff."""
    kind = dict(profiles.dtypes)[key]

    def run(group, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ring")
        fitted, cutoff = low_pass(pdf["mean"].to_numpy(dtype=float))
        return pd.DataFrame({key: group[0], "ring": pdf.ring, "background": fitted, "cutoff": cutoff})

    return profiles.select(key, "ring", "mean").groupBy(key).applyInPandas(run, f"{key} {kind}, ring bigint, background double, cutoff int")
