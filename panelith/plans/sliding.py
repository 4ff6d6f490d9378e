"""Optimisation over sliding windows: runs of dates share a task, and moments slide.

Dates are numbered once, one row per date, and dealt into runs of at least a window's length. A run's task gets its own rows and the window before
them, so a row goes to two tasks at most, whatever the window. In a task the sums of squares and products move from one date to the next: rows that come
are added, rows that go are taken off, and after ``RESET`` rows the sums are made anew, so that rounding does not pile up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dates of a run at least; rows after which sums are made anew.
RUN, RESET = 64, 256

Solver = Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]


class Moments:
    """Sample covariances of the last ``window`` rows of ``x`` (dates by assets, NaN where missing)."""

    def __init__(self, x: np.ndarray, window: int):
        self.x, self.window = x, window
        there = ~np.isnan(x)
        level = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        self._z = np.where(there, x - level, 0.0)  # covariances do not depend on the level, their digits do
        self._gap = np.vstack([np.zeros(x.shape[1], dtype=int), np.cumsum(~there, axis=0)])
        self._from = self._to = self._moved = 0
        self._s, self._ss = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)

    def rows(self, end: int) -> slice:
        return slice(max(0, end + 1 - self.window), end + 1)

    def covariance(self, end: int, cols: np.ndarray) -> np.ndarray:
        """Of the assets ``cols`` over the rows up to ``end``; all NaN if one of these lacks a value, or for a single row."""
        at = self.rows(end)
        n = at.stop - at.start
        if n < 2 or (self._gap[at.stop, cols] > self._gap[at.start, cols]).any():
            return np.full((len(cols),) * 2, np.nan)
        self._move(at.start, at.stop)
        s = self._s[cols]
        return (self._ss[np.ix_(cols, cols)] - np.outer(s, s) / n) / (n - 1)

    def _move(self, a: int, b: int) -> None:
        come, go = b - self._to, a - self._from
        if come < 0 or go < 0 or come + go > b - a or self._moved + come + go > RESET:
            z = self._z[a:b]
            self._s, self._ss, self._moved = z.sum(axis=0), z.T @ z, 0
        elif come or go:
            new, old = self._z[self._to : b], self._z[self._from : a]
            self._s = self._s + new.sum(axis=0) - old.sum(axis=0)
            self._ss = self._ss + new.T @ new - old.T @ old
            self._moved += come + go
        self._from, self._to = a, b


def numbered(panel: DataFrame) -> DataFrame:
    """obs_date, no: the panel's dates in order."""
    return panel.select("obs_date").distinct().withColumn("no", F.row_number().over(Window.orderBy("obs_date")).cast("int"))


def solved(returns: DataFrame, dates: DataFrame, ends: DataFrame, held: DataFrame | None, window: int, solve: Solver) -> DataFrame:
    """obs_date, ticker, weight for each of ``ends`` (slice_date, end): what ``solve`` gives for the last ``window`` rows up to the number ``end``.

    ``solve`` gets the returns and covariance of the tickers ``held`` (slice_date, ticker) that have rows, all by default, and the weights these had
    before in the run, or None. Where a covariance is missing the weights are 0.
    """
    run, every = max(window, RUN), held is None
    near = F.sequence(F.floor(F.col("no") / run), F.floor((F.col("no") + window - 1) / run))
    rows = returns.join(dates, "obs_date").select(F.explode(near).alias("run"), "no", "ticker", "value")
    asked = ends.select(F.floor(F.col("end") / run).alias("run"), "slice_date", "end")
    asked = asked.withColumn("ticker", F.lit(None).cast("string")) if held is None else asked.join(held, "slice_date")

    def task(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            table = rows.pivot(index="no", columns="ticker", values="value").sort_index()
            table = table.reindex(range(int(table.index[0]), int(table.index[-1]) + 1))
            first, names, m = int(table.index[0]), table.columns.to_numpy(), Moments(table.to_numpy(dtype=float), window)
            place, before = {t: k for k, t in enumerate(names)}, np.full(len(names), np.nan)
            for (day, end), own in asked.sort_values("slice_date").groupby(["slice_date", "end"], sort=True):
                at = m.rows(int(end) - first)
                cols = np.arange(len(names)) if every else np.array(sorted(place[t] for t in own["ticker"] if t in place), dtype=int)
                # tickers without a row in the window are not there
                cols = cols[~np.isnan(m.x[at][:, cols]).all(axis=0)] if len(cols) else cols
                if not len(cols):
                    continue
                cov = m.covariance(int(end) - first, cols)
                start = before[cols]
                w = np.zeros(len(cols)) if np.isnan(cov).any() else np.asarray(solve(m.x[at][:, cols], cov, None if np.isnan(start).any() else start), dtype=float)
                before[cols] = w
                out.append(pd.DataFrame({"obs_date": day, "ticker": names[cols], "weight": w}))
        return pd.concat(out) if out else pd.DataFrame({"obs_date": [], "ticker": [], "weight": []}, dtype=object)

    return rows.groupBy("run").cogroup(asked.groupBy("run")).applyInPandas(task, "obs_date date, ticker string, weight double")


#: Tables of portfolios by date: weights, and what they are worth in the window.
PORTFOLIOS = "obs_date date, no int, ticker string, weight double, mean double, volatility double"


def portfolios(returns: DataFrame, dates: DataFrame, ends: DataFrame, window: int, make: Callable[[np.ndarray, np.ndarray], np.ndarray], factor: float = 252) -> DataFrame:
    """obs_date, no, ticker, weight, mean, volatility: the portfolios (a row of weights each) that ``make`` gives for the means and covariance
    of the last ``window`` rows of each date. Dates with missing returns have none.
    """
    run = max(window, RUN)
    near = F.sequence(F.floor(F.col("no") / run), F.floor((F.col("no") + window - 1) / run))
    rows = returns.join(dates, "obs_date").select(F.explode(near).alias("run"), "no", "ticker", "value")
    asked = ends.select(F.floor(F.col("end") / run).alias("run"), "slice_date", "end")

    def task(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in PORTFOLIOS.split(", ")}, dtype=object)]
        if len(rows) and len(asked):
            table = rows.pivot(index="no", columns="ticker", values="value").sort_index()
            table = table.reindex(range(int(table.index[0]), int(table.index[-1]) + 1))
            m = Moments(table.to_numpy(dtype=float), window)
            cols = np.arange(table.shape[1])
            for day, end in asked.sort_values("slice_date")[["slice_date", "end"]].itertuples(index=False):
                at = int(end) - int(table.index[0])
                cov = m.covariance(at, cols)
                if not np.isnan(cov).any():
                    means = m.x[m.rows(at)].mean(axis=0)
                    w = np.atleast_2d(make(means, cov))
                    each = np.repeat(np.arange(len(w)), len(cols))
                    vol = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", w, cov, w), 0.0) * factor)
                    out.append(pd.DataFrame({"obs_date": day, "no": each, "ticker": np.tile(table.columns, len(w)), "weight": w.ravel(), "mean": (w @ means)[each], "volatility": vol[each]}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    return rows.groupBy("run").cogroup(asked.groupBy("run")).applyInPandas(task, PORTFOLIOS)


def inside(start: np.ndarray | None, total: float) -> np.ndarray | None:
    """A start for the barrier near earlier weights, drawn towards the middle: they may lie on their bounds."""
    return None if start is None else 0.9 * start + 0.1 * total / len(start)
