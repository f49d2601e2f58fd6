"""Trend and yearly seasonality of many series, with sparse trend changes and simulated bands.

A series' logarithm is a piecewise linear trend plus sines and cosines of the calendar month, so seasonality is
multiplicative. The slope may change at evenly spaced months of the first 80 % of the history; the changes
carry an absolute-value penalty, so most are exactly 0 and only real ones stay. The other terms are
projected out and the changes found by coordinate descent. The penalty and the noise are estimated in
turn until they agree. Beyond the history the slope goes on changing as often, and by as much, as it did in
it: such paths are simulated and give the band, which therefore widens with the step.

A series is one ``applyInPandas`` group, bounded by its months.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T, V = "month_start", "value"

# The settings of the original forecaster.
CHANGEPOINTS, CHANGE_RANGE, CHANGE_SCALE = 25, 0.8, 0.05
FOURIER, SEASON_SCALE, INTERVAL, PATHS = 10, 10.0, 0.8, 1000
SEED = 42


@dataclass
class Fit:
    """scale: of the logarithm; at, change: places and sizes of the slope's changes; rest: offset, slope and seasonal terms."""

    scale: float
    at: np.ndarray
    change: np.ndarray
    rest: np.ndarray
    noise: float

    def centre(self, t: np.ndarray, month: np.ndarray) -> np.ndarray:
        return _smooth(t, month) @ self.rest + np.maximum(0.0, t[:, None] - self.at) @ self.change


def _smooth(t: np.ndarray, month: np.ndarray) -> np.ndarray:
    angle = 2 * np.pi * np.arange(1, FOURIER + 1) * (month[:, None] - 1) / 12.0
    return np.column_stack([np.ones_like(t), t, np.sin(angle), np.cos(angle)])


def sparse_changes(gram: np.ndarray, pull: np.ndarray, penalty: float, start: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """Minimises x' gram x / 2 - pull' x + penalty * sum |x| by coordinate descent from ``start``."""
    x = start.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(gram) > 1e-12):
            free = pull[j] - gram[j] @ x + gram[j, j] * x[j]
            new = np.sign(free) * max(abs(free) - penalty, 0.0) / gram[j, j]
            moved = max(moved, abs(new - x[j]) * np.sqrt(gram[j, j]))
            x[j] = new
        if moved < 1e-9:
            break
    return x


def fit_series(value: np.ndarray, month: np.ndarray, changepoints: int = CHANGEPOINTS) -> Fit:
    """The fit of one series, oldest month first. Fewer than 12 months have no changes of slope."""
    n = len(value)
    t = np.arange(n) / max(n - 1, 1)
    y = np.log1p(np.maximum(value, 0.0))
    scale = max(float(np.abs(y).max()), 1e-9)
    y = y / scale
    k = min(changepoints, int(CHANGE_RANGE * n) - 1) if n >= 12 else 0
    at = np.linspace(0, CHANGE_RANGE, k + 1)[1:] if k > 0 else np.zeros(0)
    smooth, hinge = _smooth(t, month), np.maximum(0.0, t[:, None] - at)
    change, noise = np.zeros(len(at)), max(float(np.std(y)), 1e-4)
    for _ in range(20):
        ridge = np.full(smooth.shape[1], (noise / SEASON_SCALE) ** 2 + 1e-9)
        ridge[:2] = 1e-9
        solve = np.linalg.solve(smooth.T @ smooth + np.diag(ridge), smooth.T)
        left = np.eye(n) - smooth @ solve  # what the smooth terms leave of a column
        change = sparse_changes(hinge.T @ left @ hinge, hinge.T @ left @ y, noise ** 2 / CHANGE_SCALE, change)
        rest = solve @ (y - hinge @ change)
        spread = max(float(np.sqrt(np.mean((y - smooth @ rest - hinge @ change) ** 2))), 1e-4)
        if abs(spread - noise) <= 1e-4 * noise:
            break
        noise = spread
    return Fit(scale, at, change, rest, noise)


def simulate(fit: Fit, t: np.ndarray, month: np.ndarray, seed: int, paths: int = PATHS) -> np.ndarray:
    """(paths, months) of possible values of the scaled logarithm after the history: as many changes of slope per
    unit of time as the history allows, of the mean size that it shows, and the noise."""
    rng = np.random.default_rng(seed)
    size = float(np.abs(fit.change).mean()) if len(fit.change) else 0.0
    span = float(t[-1]) - 1.0
    many = rng.poisson(len(fit.at) / CHANGE_RANGE * span, paths)
    path = np.repeat(np.arange(paths), many)
    place = 1.0 + span * rng.random(len(path))
    change = rng.laplace(0.0, size + 1e-8, len(path))
    drift = np.zeros((paths, len(t)))
    np.add.at(drift, path, change[:, None] * np.maximum(0.0, t[None, :] - place[:, None]))
    return fit.centre(t, month)[None, :] + drift + rng.normal(0.0, fit.noise, drift.shape)


def _series(df: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    clean = df.filter(F.col(V).isNotNull()).select(*keys, T, F.col(V).cast("double").alias(V))
    return clean, ", ".join(f"`{k}` {dict(clean.dtypes)[k]}" for k in keys)


def _months(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
    pdf = pdf.sort_values(T)
    return pdf, pd.to_datetime(pdf[T])


def seasonal_trend_fit(df: DataFrame, keys: list[str], horizon: int = 3, interval: float = INTERVAL) -> DataFrame:
    """(keys, step, month_start, yhat, yhat_lower, yhat_upper): the next ``horizon`` months of every series, at least 0.
    Months without a value are left out; reruns agree."""
    clean, kinds = _series(df, keys)

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, months = _months(pdf)
        fit = fit_series(pdf[V].to_numpy(float), months.dt.month.to_numpy(float))
        n, step = len(pdf), np.arange(1, horizon + 1)
        ahead = pd.DatetimeIndex([months.iloc[-1] + pd.DateOffset(months=int(s)) for s in step])
        t, month = (n - 1 + step) / max(n - 1, 1), ahead.month.to_numpy(float)
        paths = simulate(fit, t, month, crc32("|".join(str(pdf[k].iloc[0]) for k in keys).encode()) + SEED)
        low, high = np.quantile(paths, [(1 - interval) / 2, (1 + interval) / 2], axis=0)
        back = lambda y: np.maximum(np.expm1(y * fit.scale), 0.0)
        out = pd.DataFrame({"step": step.astype(np.int32), T: ahead.date, "yhat": back(fit.centre(t, month)), "yhat_lower": back(low), "yhat_upper": back(high)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return clean.groupBy(*keys).applyInPandas(forecast, f"{kinds}, step int, {T} date, yhat double, yhat_lower double, yhat_upper double")


def changepoints(df: DataFrame, keys: list[str], least: float = 1e-6) -> DataFrame:
    """(keys, month_start, change): the months at which a series' trend bends, with the change of its logarithm's slope
    a month."""
    clean, kinds = _series(df, keys)

    def bends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, months = _months(pdf)
        fit = fit_series(pdf[V].to_numpy(float), months.dt.month.to_numpy(float))
        months_long = max(len(pdf) - 1, 1)
        kept = np.abs(fit.change) > least
        out = pd.DataFrame({T: months.iloc[np.rint(fit.at[kept] * months_long).astype(int)].dt.date.to_numpy(), "change": fit.change[kept] * fit.scale / months_long})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return clean.groupBy(*keys).applyInPandas(bends, f"{kinds}, {T} date, change double")
