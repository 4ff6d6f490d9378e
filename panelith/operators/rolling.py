"""Rolling metrics per ticker. All windows of one metric share one shuffle by ticker."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof
from .clean import staleness_mask
from .frames import by_ticker, guarded, last_rows, published


def _filled(col: str = "value") -> Column:
    return F.last(col, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def _ratio(now: Column, before: Column) -> Column:
    return F.try_divide(now, before) - 1


def pct_change_pad(panel: DataFrame, lag: int = 1, out: str = "value") -> DataFrame:
    """Change against the row ``lag`` before, after filling forward."""
    filled = panel.withColumn("__f", _filled())
    return filled.withColumn(out, _ratio(F.col("__f"), F.lag("__f", lag).over(by_ticker()))).drop("__f")


def pct_change_raw(panel: DataFrame, lag: int = 1, out: str = "value") -> DataFrame:
    """Change against the row ``lag`` before; NULL if either is."""
    return panel.withColumn(out, _ratio(F.col("value"), F.lag("value", lag).over(by_ticker())))


def holding_period_return(panel: DataFrame, lag: int, ending_lag: int = 0, skip_nan: bool = False) -> DataFrame:
    """Return from ``lag`` rows ago to ``ending_lag`` rows ago."""
    if ending_lag < 0 or lag <= ending_lag:
        raise ValueError("lag > ending_lag >= 0 is needed")
    if skip_nan:
        w = published()
        return panel.withColumn("value", _ratio(F.lag("value", ending_lag).over(w), F.lag("value", lag).over(w)))
    w = by_ticker()
    filled = panel.withColumn("__f", _filled())
    return filled.withColumn("value", _ratio(F.lag("__f", ending_lag).over(w), F.lag("__f", lag).over(w))).drop("__f")


def simple_moving_average(panel: DataFrame, window: int | None = None, skip_nan: bool = False) -> DataFrame:
    """Mean of the last rows; every row of the window needs a value. All rows so far for None."""
    w = published() if skip_nan else by_ticker()
    return panel.withColumn("value", guarded(F.avg("value"), F.col("value"), w, window))


def realized_volatility(panel: DataFrame, return_lag: int | None = None, window: int | None = None, skip_nan: bool = False, annualization_factor: float = 252) -> DataFrame:
    """Standard deviation of the values, or of their returns, over the last rows, annualised."""
    w = published() if skip_nan else by_ticker()
    ret = _ratio(F.col("value"), F.lag("value", return_lag).over(w)) if return_lag else F.col("value")
    return panel.withColumn("__r", ret).withColumn("value", guarded(F.stddev_samp("__r"), F.col("__r"), w if not skip_nan else published(), window, window or 2) * math.sqrt(annualization_factor)).drop("__r")


def realized_beta(panel: DataFrame, beta_ticker: str, return_lag: int | None = None, window: int | None = None, skip_nan: bool = False) -> DataFrame:
    """Rolling covariance with one of the tickers over its variance."""
    beta_ticker = beta_ticker.upper()
    if not panel.where(F.col("ticker") == beta_ticker).take(1):
        raise ValueError(f"{beta_ticker} is not in the panel")
    bench = panel.where(F.col("ticker") == beta_ticker).select("obs_date", F.col("value").alias("__b"))
    both = panel.join(bench, "obs_date", "left")
    if skip_nan:
        both = both.withColumn("__pair", F.when(F.col("__b").isNotNull(), F.col("value")))
        w = published("__pair")
    else:
        w = by_ticker()
    if return_lag:
        x, b = _ratio(F.col("value"), F.lag("value", return_lag).over(w)), _ratio(F.col("__b"), F.lag("__b", return_lag).over(w))
    else:
        x, b = F.col("value"), F.col("__b")
    both = both.withColumn("__x", x).withColumn("__y", b)
    pair = F.col("__x") + F.col("__y")
    value = guarded(F.covar_samp("__x", "__y"), pair, w, window, window or 2) / F.nullif(guarded(F.var_samp(F.when(pair.isNotNull(), F.col("__y"))), pair, w, window, window or 2), F.lit(0.0))
    return both.withColumn("value", value).select(*panel.columns)


def _lags(lags: int | Sequence[int], least: int) -> list[int]:
    out = [lags] if isinstance(lags, int) else list(lags)
    if not out or min(out) < least:
        raise ValueError(f"lags are at least {least}")
    return out


def _combine(columns: list[Column], how: str) -> Column:
    """Greatest or mean of several columns; NULL if any is."""
    if how not in ("max", "avg"):
        raise ValueError("several lags are combined by max or avg")
    whole = columns[0]
    for c in columns[1:]:
        whole = whole + c
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return F.when(whole.isNotNull(), top if how == "max" else whole / len(columns))


def _metric(panel: DataFrame, columns: list[Column], how: str, max_missing: int | None, least: int = 1) -> DataFrame:
    """The metric filled forward and masked; an error, when the plan runs, for tickers of fewer than ``least`` rows."""
    if least > 1:
        short = F.count(F.lit(1)).over(Window.partitionBy("ticker")) < least
        panel = panel.withColumn("value", F.when(short, F.raise_error(F.lit(f"at least {least} rows are needed")).cast("double")).otherwise(F.col("value")))
    out = panel.withColumn("__m", _combine(columns, how)).withColumn("__m", _filled("__m"))
    return staleness_mask(out, "value", "__m", max_missing).withColumn("value", F.col("__m"))


def _one_of(prices: DataFrame | None, returns: DataFrame | None) -> tuple[DataFrame, bool]:
    if (prices is None) == (returns is None):
        raise ValueError("give either prices or returns")
    return (prices, True) if prices is not None else (returns, False)


def volatility(prices: DataFrame | None = None, returns: DataFrame | None = None, lags: int | Sequence[int] = 60, return_lag: int = 1, factor: float = 252, max_missing: int | None = 5, combine: str = "max") -> DataFrame:
    """Realised volatility over each ticker's published rows, on the whole calendar: filled forward and masked where stale."""
    panel, price = _one_of(prices, returns)
    w = published()
    panel = panel.repartition("ticker").withColumn("__r", _ratio(F.col("value"), F.lag("value", return_lag).over(w)) if price else F.col("value"))
    columns = [guarded(F.stddev_samp("__r"), F.col("__r"), w, n) * math.sqrt(factor) for n in _lags(lags, 2)]
    return _metric(panel, columns, combine, max_missing, max(_lags(lags, 2)) + price + return_lag - 1).select("obs_date", "ticker", "value")


def rolling_average(panel: DataFrame, lags: int | Sequence[int], max_missing: int | None = 5, combine: str = "avg") -> DataFrame:
    """Mean over published rows, filled forward and masked where stale."""
    w = published()
    columns = [guarded(F.avg("value"), F.col("value"), w, n) for n in _lags(lags, 1)]
    return _metric(panel.repartition("ticker"), columns, combine, max_missing, max(_lags(lags, 1))).select("obs_date", "ticker", "value")


def relative_sma(prices: DataFrame, lag: int, max_missing: int | None = 5) -> DataFrame:
    """Moving average over the last price."""
    w = published()
    panel = prices.repartition("ticker").withColumn("__spot", _filled())
    out = _metric(panel, [guarded(F.avg("value"), F.col("value"), w, n) for n in _lags(lag, 1)], "avg", max_missing)
    return out.select("obs_date", "ticker", F.try_divide("value", "__spot").alias("value"))


def beta(prices: DataFrame | None = None, returns: DataFrame | None = None, benchmark: DataFrame | None = None, lags: int | Sequence[int] = 252, return_lag: int = 1, max_missing: int | None = 5, combine: str = "avg") -> DataFrame:
    """Beta against ``benchmark`` prices (obs_date, value), which are taken as of each ticker's own dates."""
    panel, price = _one_of(prices, returns)
    m = asof.calendar_map(panel, benchmark.where("value is not null"))
    bench = m.join(benchmark.select(F.col("obs_date").alias("as_of"), F.col("value").alias("__p")), "as_of").select("obs_date", "__p")
    w = published()
    panel = panel.join(bench, "obs_date", "left").repartition("ticker")
    panel = panel.withColumn("__x", _ratio(F.col("value"), F.lag("value", return_lag).over(w)) if price else F.col("value"))
    panel = panel.withColumn("__y", _ratio(F.col("__p"), F.lag("__p", return_lag).over(w)))
    pair = F.col("__x") + F.col("__y")
    y = F.when(pair.isNotNull(), F.col("__y"))
    columns = [guarded(F.covar_samp("__x", "__y"), pair, w, n) / F.nullif(guarded(F.var_samp(y), pair, w, n), F.lit(0.0)) for n in _lags(lags, 2)]
    return _metric(panel, columns, combine, max_missing, max(_lags(lags, 2)) + price + return_lag - 1).select("obs_date", "ticker", "value")


def rolling_drawdown(prices: DataFrame, look_back: int | None = None) -> DataFrame:
    """Price over its greatest in the look-back, less one; over all rows so far for None."""
    if look_back is not None and look_back < 1:
        raise ValueError("the look-back is at least 1")
    filled = prices.withColumn("__f", _filled())
    top = F.max("__f").over(last_rows(by_ticker(), look_back))
    return filled.withColumn("value", _ratio(F.col("__f"), top)).drop("__f")


def maximum_drawdown(prices: DataFrame, look_back: int | None = None) -> DataFrame:
    return rolling_drawdown(prices, look_back).groupBy("ticker").agg(F.min("value").alias("value"))


def exponentially_weighted_return(prices: DataFrame, lambda_: float) -> DataFrame:
    """Daily returns times exp(-lambda / N * (1 + age)); the newest row has age 0."""
    changed = pct_change_pad(prices)
    age = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("obs_date"))) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return changed.withColumn("value", F.col("value") * F.exp(F.lit(-float(lambda_)) / n * (1 + age)))


def returns_to_prices(returns: DataFrame, initial: float = 1.0) -> DataFrame:
    """Prices with ``initial`` on the row before the first return; NULL, and not compounded, where the next return is missing, but on
    the last row."""
    w = by_ticker()
    shown = F.lead("value").over(w).isNotNull() | F.lead("obs_date").over(w).isNull()
    factors = returns.withColumn("__f", F.when(shown, 1 + F.coalesce("value", F.lit(0.0))))
    grown = F.product("__f").over(last_rows(w, None)) * float(initial)
    return factors.withColumn("value", F.when(F.col("__f").isNotNull(), grown)).drop("__f")
