"""Filling, masking and reshaping of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_date, by_ticker

POLICIES = (None, "skip", "ffill", "bfill", "drop")


def ffill(panel: DataFrame, col: str = "value") -> DataFrame:
    return panel.withColumn(col, F.last(col, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))


def bfill(panel: DataFrame, col: str = "value") -> DataFrame:
    return panel.withColumn(col, F.first(col, ignorenulls=True).over(by_ticker().rowsBetween(0, Window.unboundedFollowing)))


def drop_incomplete_dates(panel: DataFrame, col: str = "value") -> DataFrame:
    """Dates on which no ticker lacks a value."""
    w = by_date()
    return panel.withColumn("__n", F.count(F.when(F.col(col).isNull(), 1)).over(w)).where("__n = 0").drop("__n")


def drop_empty_dates(panel: DataFrame, col: str = "value") -> DataFrame:
    """Dates on which some ticker has a value."""
    return panel.withColumn("__n", F.count(col).over(by_date())).where("__n > 0").drop("__n")


def null_policy(panel: DataFrame, policy: str | None) -> DataFrame:
    """None: as is; skip: rows without a value go; ffill and bfill; drop: incomplete dates go."""
    if policy not in POLICIES:
        raise ValueError(f"the null policy is one of {POLICIES}")
    if policy == "skip":
        return panel.where("value is not null")
    return {None: lambda p: p, "ffill": ffill, "bfill": bfill, "drop": drop_incomplete_dates}[policy](panel)


def fill(panel: DataFrame, ffill_na: bool = False, bfill_na: bool = False, drop_na: bool = False) -> DataFrame:
    """Forward fill, back fill and dropping of incomplete dates, in that order."""
    for wanted, step in ((ffill_na, ffill), (bfill_na, bfill), (drop_na, drop_incomplete_dates)):
        panel = step(panel) if wanted else panel
    return panel


def null_before(panel: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """NULL up to and including each ticker's ``cutoff``; tickers without one stay as they are."""
    joined = panel.join(cutoffs.select("ticker", "cutoff"), "ticker", "left")
    return joined.withColumn("value", F.when(F.col("cutoff").isNull() | (F.col("obs_date") > F.col("cutoff")), F.col("value"))).drop("cutoff")


def staleness_mask(panel: DataFrame, original: str, value: str, max_missing: int | None) -> DataFrame:
    """``value`` only where one of the last ``max_missing + 1`` originals is there; None keeps all."""
    if max_missing is None:
        return panel
    fresh = F.count(original).over(by_ticker().rowsBetween(-max_missing, 0)) > 0
    return panel.withColumn(value, F.when(fresh, F.col(value)))


def clip(panel: DataFrame, low: float | None = None, high: float | None = None, col: str = "value") -> DataFrame:
    """Clamps values; NULL stays NULL."""
    c = F.col(col)
    out = c if low is None else F.greatest(c, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return panel.withColumn(col, F.when(c.isNotNull(), out))


def wide(panel: DataFrame, tickers: Sequence[str], col: str = "value") -> DataFrame:
    """One column per listed ticker."""
    return panel.groupBy("obs_date").pivot("ticker", list(tickers)).agg(F.first(col))


def long(frame: DataFrame, date_col: str = "obs_date", value: str = "value") -> DataFrame:
    """Wide to long; cells without a value go."""
    out = frame.unpivot([date_col], [c for c in frame.columns if c != date_col], "ticker", value)
    return out.withColumnRenamed(date_col, "obs_date").where(F.col(value).isNotNull())
