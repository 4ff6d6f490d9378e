"""Windows over a long panel ``(obs_date, ticker, value)``.

A panel is dense if every ticker has a row for every date; missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("obs_date")


def by_date(*order) -> WindowSpec:
    w = Window.partitionBy("obs_date")
    return w.orderBy(*order) if order else w


def published(col: str = "value") -> WindowSpec:
    """Per ticker over the rows that have a value; rows without one form a partition of their own.

    A panel dealt by ticker needs no further shuffle for it.
    """
    return Window.partitionBy("ticker", F.col(col).isNull()).orderBy("obs_date")


def last_rows(w: WindowSpec, n: int | None) -> WindowSpec:
    """The last n rows including the present one; all rows so far for None."""
    return w.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, Window.currentRow)


def guarded(agg: Column, counted: Column, w: WindowSpec, n: int | None, least: int | None = None) -> Column:
    """``agg`` over the last n rows where at least ``least`` of ``counted`` are there (n, or 1 for all rows)."""
    f = last_rows(w, n)
    return F.when(F.count(counted).over(f) >= (least or n or 1), agg.over(f))


def dense(panel: DataFrame, dates: DataFrame | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """Every date with every ticker. The grid of the two distinct lists is the panel's own size."""
    dates = (dates if dates is not None else panel).select("obs_date").distinct()
    tickers = (tickers if tickers is not None else panel).select("ticker").distinct()
    return dates.crossJoin(tickers).join(panel, ["obs_date", "ticker"], "left")


def no_nan(col: str) -> Column:
    """NaN and infinities as NULL, for data from outside."""
    c = F.col(col)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def skip_sum(col: Column) -> Column:
    """Sum that skips NULL and is 0 over nothing."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def strict_sum(col: Column) -> Column:
    """Sum that is NULL if any term is."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))
