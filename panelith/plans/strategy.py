"""Systematic strategies: universe, signals, weights, overlays, index.

Every part is a lazy DataFrame transform; a back-test is one plan. Windows over dates alone run on one row per date.
"""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sliding
from .demand import Panel, Span, cut, span_of
from ..functions import optimize
from ..functions.calendar import business_shift, monotonic, year_fraction
from ..functions.calendar import date_range as made_range
from ..operators import asof, clean, cross, rolling
from ..operators.frames import by_date, by_ticker, dense, guarded, last_rows, skip_sum, strict_sum
from ..sources.shared import materialized

PANEL = "obs_date date, ticker string, value double"


def on_dates():
    """Over the dates of a series, which has one row per date."""
    return Window.orderBy("obs_date")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


class Universe:
    """Tickers on an observation calendar; filters multiply into the eligibility (1 or 0).

    The calendar is a DataFrame or, as with ``calendar.date_range``, given by three of ``start``, ``end``, ``periods`` and ``freq``.
    """

    def __init__(self, tickers: Sequence[str], calendar: DataFrame | None = None, *, spark=None, **date_range):
        if (calendar is None) == (not date_range):
            raise ValueError("a calendar is needed, or start, end, periods and freq of one")
        if calendar is None:
            calendar = made_range(spark or SparkSession.active(), **date_range)
        if isinstance(tickers, str):
            tickers = [tickers]
        if not isinstance(tickers, (list, tuple)):
            raise TypeError("tickers are a string, a list or a tuple")
        self.calendar = monotonic(calendar.select("obs_date"))
        self.tickers = [t.upper() for t in tickers]
        names = calendar.sparkSession.createDataFrame([(t,) for t in self.tickers], "ticker string")
        self._eligible = dense(self.calendar.crossJoin(names).withColumn("value", F.lit(1.0)))
        self.filters: list[str] = []
        self._span: Span | None = None

    def span(self) -> Span:
        """First and last date of the calendar."""
        if self._span is None:
            self._span = span_of(self.calendar)
        return self._span

    def _apply(self, panel: DataFrame, description: str) -> "Universe":
        on = asof.on_calendar(panel, self.calendar).withColumnRenamed("value", "__f")
        self._eligible = self._eligible.join(on, ["obs_date", "ticker"], "left").withColumn("value", F.col("value") * F.col("__f")).drop("__f")
        self.filters.append(description)
        return self

    def custom(self, eligibility: DataFrame, description: str = "custom filter") -> "Universe":
        """A panel of 1 and 0 (or NULL) over exactly the universe's tickers."""
        names = {r[0] for r in eligibility.select("ticker").distinct().limit(len(self.tickers) + 1).collect()}
        _require(names == set(self.tickers), "the filter needs the universe's tickers")
        monotonic(eligibility.select("obs_date").distinct())
        return self._apply(eligibility, description)

    def liquidity(self, liquidity: Panel, lag: int, threshold: float) -> "Universe":
        """Mean liquidity above the threshold."""
        _require(lag >= 1, "the lag is at least 1")
        liquidity = cut(liquidity, self.span, lag + 1)
        on = rolling.rolling_average(liquidity, lag).withColumn("value", F.when(F.col("value") > threshold, 1.0).otherwise(0.0))
        return self._apply(on, f"average liquidity over {lag} > {threshold}")

    def price_history(self, close: Panel, n: int, tolerance: float = 0.95) -> "Universe":
        """At least ``tolerance`` of the last n closes are there."""
        _require(n >= 1, "n is at least 1")
        close = cut(close, self.span, n + 1)
        enough = F.count("value").over(last_rows(by_ticker(), n)) >= int(tolerance * n)
        return self._apply(close.withColumn("value", F.when(enough, 1.0).otherwise(0.0)), f"{tolerance:g} of the last {n} closes")

    def published(self, close: Panel, n: int) -> "Universe":
        """A close in the last n rows, once a full run of n has occurred: that may be long ago, so everything is needed."""
        close = cut(close, self.span, None)
        return self._apply(published_filter(close, n), f"a close in the last {n} rows")

    def eligibility(self, only_eligible: bool = False) -> DataFrame:
        """1 or NULL; with ``only_eligible`` the tickers that are eligible at some date."""
        out = self._eligible.withColumn("value", F.nullif("value", F.lit(0.0)))
        if only_eligible:
            ever = self.eligible_tickers()
            _require(bool(ever.take(1)), "no ticker is ever eligible")
            out = out.join(ever, "ticker", "left_semi")
        return out.select("obs_date", "ticker", "value")

    def eligible_tickers(self) -> DataFrame:
        return self._eligible.groupBy("ticker").agg(F.sum("value").alias("n")).where("n > 0").select("ticker")


def published_filter(close: DataFrame, n: int) -> DataFrame:
    w = last_rows(by_ticker(), n)
    counted = close.withColumn("__n", F.count("value").over(w))
    ran = F.max((F.col("__n") == n).cast("int")).over(last_rows(by_ticker(), None)) == 1
    return counted.withColumn("value", F.when((F.col("__n") > 0) & ran, 1.0).otherwise(0.0)).drop("__n")


def look_back(windows: int | Sequence[int] | None, freq: int | str | None = 1, sampled: bool = False) -> int | None:
    """Business days of prices that a metric over the windows needs before its first date, with a margin of a quarter (15 days at least).

    A weekly frequency, or every freq-th row if ``sampled``, stretches it. None for no window: everything is needed.
    """
    if windows is None:
        return None
    days = max(windows) if isinstance(windows, (list, tuple)) else windows
    days += 5 if isinstance(freq, str) else (freq or 1) - 1
    whole = days + max(days * 0.25, 15)
    return int(whole * (5 if isinstance(freq, str) else (freq or 1) if sampled else 1))


def pruned(prices: DataFrame, signal: DataFrame, windows: int | Sequence[int] | None, freq: int | str | None = 1, sampled: bool = False) -> DataFrame:
    """The prices that metrics on the signal's dates need, from ``look_back`` days before the first to the last; the bounds are one row.

    An estimate for panels of which nothing is known; what a ``StoredPanel`` opens is exact.
    """
    days = look_back(windows, freq, sampled)
    span = signal.agg(F.min("obs_date").alias("__lo"), F.max("obs_date").alias("__hi"))
    inside = F.col("obs_date") <= F.col("__hi")
    if days is not None:
        inside = inside & (F.col("obs_date") >= business_shift(F.col("__lo"), -days))
    return prices.crossJoin(F.broadcast(span)).where(inside).select(*prices.columns)


# signals


class Signal:
    """A panel on the eligibility's calendar, NULL where a ticker isn't eligible. Subclasses give ``raw``.

    Of a universe the calendar's dates are known, and so which part of stored prices is needed.
    """

    def __init__(self, eligibility: DataFrame | Universe):
        self.universe = eligibility if isinstance(eligibility, Universe) else None
        self.eligibility = eligibility.eligibility() if isinstance(eligibility, Universe) else eligibility

    def span(self) -> Span:
        return self.universe.span() if self.universe is not None else span_of(self.eligibility)

    def raw(self) -> DataFrame:
        return self.eligibility

    def compute(self) -> DataFrame:
        on = asof.on_calendar(self.raw(), self.eligibility).withColumnRenamed("value", "__s")
        return self.eligibility.join(on, ["obs_date", "ticker"], "left").select("obs_date", "ticker", (F.col("value") * F.col("__s")).alias("value"))


class SmaCross(Signal):
    """-1 where the shorter moving average lies below the longer one, else 1 (also where one is undefined)."""

    def __init__(self, eligibility: DataFrame | Universe, prices: Panel, lag_1: int, lag_2: int | None = None, freq=None):
        super().__init__(eligibility)
        lags = [lag_1, 1 if lag_2 is None else lag_2]
        _require(min(lags) >= 1, "lags are at least 1")
        self.prices, self.lead, self.lagging = cross.frequency_filter(cut(prices, self.span, max(lags) + 1, freq), freq), min(lags), max(lags)

    def raw(self) -> DataFrame:
        fast = rolling.rolling_average(self.prices, self.lead).withColumnRenamed("value", "__fast")
        slow = rolling.rolling_average(self.prices, self.lagging).withColumnRenamed("value", "__slow")
        both = fast.join(slow, ["obs_date", "ticker"])
        return both.select("obs_date", "ticker", F.when(F.col("__fast") < F.col("__slow"), -1.0).otherwise(1.0).alias("value"))


class RankSignal(Signal):
    """1 for the first-ranked by ``metric``, a panel or a function of the signal's span that gives one."""

    def __init__(self, eligibility: DataFrame | Universe, metric: DataFrame | Callable[[Callable[[], Span]], DataFrame], ascending: bool, **how):
        super().__init__(eligibility)
        self.metric, self.ascending, self.how = metric, ascending, how

    def compute(self) -> DataFrame:
        m = self.metric(self.span) if callable(self.metric) else self.metric
        return cross.top_k(m, self.eligibility, ascending=self.ascending, **self.how)


def _most(lags: int | Sequence[int]) -> int:
    return lags if isinstance(lags, int) else max(lags)


def volatility_rank(eligibility: DataFrame | Universe, prices: Panel, lags, return_lag: int = 1, ascending: bool = True, freq=None, **how) -> RankSignal:
    def metric(span: Callable[[], Span]) -> DataFrame:
        needed = cross.frequency_filter(cut(prices, span, _most(lags) + return_lag + 1, freq), freq)
        return rolling.volatility(prices=needed, lags=lags, return_lag=return_lag, factor=cross.annualization_factor(freq))

    return RankSignal(eligibility, metric, ascending, **how)


def average_performance(prices: DataFrame, lags: int | Sequence[int]) -> DataFrame:
    """Mean over the lags of the padded returns; NULL if any is."""
    lags = [lags] if isinstance(lags, int) else list(lags)
    _require(min(lags) >= 1, "lags are at least 1")
    filled = clean.ffill(prices)
    terms = [F.col("value") / F.lag("value", n).over(by_ticker()) - 1 for n in lags]
    return filled.withColumn("value", reduce(lambda a, b: a + b, terms) / len(lags))


def performance_rank(eligibility: DataFrame | Universe, prices: Panel, lags, ascending: bool = False, freq=None, **how) -> RankSignal:
    return RankSignal(eligibility, lambda span: average_performance(cross.frequency_filter(cut(prices, span, _most(lags) + 1, freq), freq), lags), ascending, **how)


# weights


def equal_weight(signal: DataFrame, net_zero: bool = False) -> DataFrame:
    """The signal over the number of signals of its date; with ``net_zero`` over those of its own sign."""
    n = F.count(F.when(F.signum("value") == 1, 1)).over(by_date())
    m = F.count(F.when(F.signum("value") == -1, 1)).over(by_date())
    if net_zero:
        w = F.when(F.col("value") > 0, F.col("value") / n).when(F.col("value") < 0, F.col("value") / m)
    else:
        w = F.try_divide(F.col("value"), F.count("value").over(by_date()))
    return signal.withColumn("value", F.coalesce(w, F.lit(0.0)))


def static_weight(signal: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights in percent by (ticker, signal): a table instead of a prompt. Warns if a date's total isn't 1."""
    table = weights.select("ticker", F.col("signal").cast("double").alias("__s"), (F.col("weight") / 100).alias("__w"))
    out = signal.join(table, (signal["ticker"] == table["ticker"]) & (F.col("value") == F.col("__s")), "left")
    out = out.select("obs_date", signal["ticker"], F.coalesce("__w", F.lit(0.0)).alias("value"))
    if out.groupBy("obs_date").agg(F.sum("value").alias("t")).where("abs(t - 1) > 1e-9").take(1):
        warnings.warn("the static weights of a date don't add up to 1", stacklevel=2)
    return out


def proportional_weight(signal: DataFrame, panel: DataFrame, inverse: bool = False) -> DataFrame:
    """A metric (or its reciprocal) over its sum of the date, times the signal; a reciprocal of zero counts as missing."""
    x = F.try_divide(F.lit(1.0), F.col("value")) if inverse else F.col("value")
    on = asof.on_calendar(panel.withColumn("value", x), signal).withColumnRenamed("value", "__x")
    both = signal.join(on, ["obs_date", "ticker"], "left").withColumn("__x", F.when(F.col("value").isNotNull(), F.col("__x")))
    share = F.try_divide(F.col("__x"), F.sum("__x").over(by_date()))
    return both.select("obs_date", "ticker", F.coalesce(share * F.col("value"), F.lit(0.0)).alias("value"))


def volatility_weight(signal: DataFrame, prices: DataFrame, lags=60, return_lag: int = 1, inverse: bool = True, freq=None) -> DataFrame:
    prices = cross.frequency_filter(clean.ffill(prices), freq) if freq not in (None, 1) else prices
    vol = rolling.volatility(prices=prices, lags=lags, return_lag=return_lag, factor=cross.annualization_factor(freq) / return_lag)
    return proportional_weight(signal, vol, inverse)


class PricedWeight:
    """A weight function of a signal and prices that looks ``rows`` rows back from the first date."""

    def __init__(self, function: Callable[..., DataFrame], prices: Panel, rows: int | None, freq: int | str | None = None, **how):
        self.function, self.prices, self.rows, self.freq, self.how = function, prices, rows, freq, how
        self.__name__ = function.__name__

    def over(self, span: Callable[[], Span]) -> Callable[[DataFrame], DataFrame]:
        """The function of the signal alone, with what it needs of the prices."""
        needed = cut(self.prices, span, self.rows, self.freq)
        return lambda signal: self.function(signal, needed, freq=self.freq, **self.how)

    def __call__(self, signal: DataFrame) -> DataFrame:
        return self.over(lambda: span_of(signal))(signal)


def by_volatility(prices: Panel, lags=60, return_lag: int = 1, inverse: bool = True, freq=None) -> PricedWeight:
    return PricedWeight(volatility_weight, prices, _most(lags) + return_lag + 1, freq, lags=lags, return_lag=return_lag, inverse=inverse)


def by_optimizer(prices: Panel, window: int | None, return_lag: int = 1, freq=None, **how) -> PricedWeight:
    return PricedWeight(optimized_weight, prices, None if window is None else window + return_lag + 1, freq, window=window, return_lag=return_lag, **how)


def bounded(weights: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    return clean.clip(weights, low, high)


def optimized_weight(signal: DataFrame, prices: DataFrame, window: int | None, *, kind: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "minimum_variance", min_total: float = 1.0, max_total: float = 1.0, low=None, high=None, return_lag: int = 1, freq=None, clean_returns: bool = True, factor: float | None = None, **how) -> DataFrame:
    """Optimised weights of the eligible tickers of each date, from the returns of the last ``window`` rows up to it (all for None).

    Without bounds per instrument and with one total, minimum variance has the analytic solution. Runs of dates share a task (see ``sliding``);
    without a window each date is a task of its own. ``kind`` may be a function of the returns (dates by tickers) and their covariance that
    gives the weights. Problems are convex, so no solution depends on another's start.
    """
    _require(callable(kind) or kind in ("minimum_variance", "mean_variance"), "kind is minimum_variance, mean_variance or a function of returns and covariance")
    _require(window is None or window >= 1, "the window is at least 1")
    factor = factor or cross.annualization_factor(freq)
    filled = cross.frequency_filter(clean.ffill(prices), freq)
    returns = filled.withColumn("value", F.col("value") / F.lag("value", return_lag).over(by_ticker()) - 1)
    if clean_returns:
        returns = returns.withColumn("value", F.coalesce("value", F.lit(0.0)))
    held = signal.where("value is not null").select(F.col("obs_date").alias("slice_date"), "ticker")

    def solve(x: np.ndarray, cov: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        if callable(kind):
            return np.asarray(kind(x, cov), dtype=float)
        if kind == "minimum_variance" and low is None and high is None and min_total == max_total:
            return optimize.analytic(cov, allocation=max_total)
        guess = sliding.inside(start, max_total)
        if kind == "minimum_variance":
            return optimize.minimum_variance(cov, guess, total=max_total, low=low, high=high)
        return optimize.mean_variance(np.nanmean(x, axis=0), cov, guess, min_total, max_total, low, high, factor=factor, **how)

    if window is not None:
        dates = sliding.numbered(returns)
        ends = asof.calendar_map(signal, returns).where("as_of is not null").select(F.col("obs_date").alias("slice_date"), F.col("as_of").alias("obs_date"))
        ends = ends.join(dates, "obs_date").select("slice_date", F.col("no").alias("end"))
        solved = sliding.solved(returns, dates, ends, held, window, solve)
    else:

        def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            table = rows.pivot(index="obs_date", columns="ticker", values="value").sort_index()
            x = table.to_numpy(dtype=float)
            cov = np.atleast_2d(np.cov(x.T)) if len(x) > 1 else np.full((x.shape[1],) * 2, np.nan)
            w = np.zeros(x.shape[1]) if np.isnan(cov).any() else solve(x, cov, None)
            return pd.DataFrame({"obs_date": key[0], "ticker": table.columns, "weight": w})

        slices = asof.trailing_slices(returns, signal, None).join(held, ["slice_date", "ticker"], "left_semi")
        solved = slices.groupBy("slice_date").applyInPandas(whole, "obs_date date, ticker string, weight double")
    return signal.join(solved, ["obs_date", "ticker"], "left").select("obs_date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("value"))


# overlays, on (obs_date, ticker, ret, weight)


def strategy_return(both: DataFrame, lag: int = 1) -> DataFrame:
    """Return of the weighted basket per date: missing terms skipped, NULL if all are missing."""
    term = both.withColumn("__t", F.col("ret") * F.lag("weight", lag).over(by_ticker()))
    return term.groupBy("obs_date").agg(F.sum("__t").alias("value"))


def _scaled(factor: DataFrame, low: float | None, high: float | None, shift: int, smoothing: int) -> DataFrame:
    """A series of scaling factors: clamped, moved ``shift`` rows and smoothed over full windows."""
    out = clean.clip(factor, low, high).withColumn("value", F.lag("value", shift).over(on_dates()) if shift else F.col("value"))
    return out.withColumn("value", guarded(F.avg("value"), F.col("value"), on_dates(), smoothing)) if smoothing > 1 else out


class VolatilityTarget:
    """Weights times target over realised volatility of the strategy; ``smoothing`` means the scaled weights over full windows."""

    def __init__(self, target: float, lags=60, return_lag: int = 1, weight_lag: int = 2, factor_lag: int = 1, smoothing: int = 1, high: float = 1.0, low: float = 0.0):
        _require(target > 0, "the target is positive")
        _require(weight_lag >= 1 and factor_lag >= 0 and smoothing >= 1, "weight_lag >= 1, factor_lag >= 0 and smoothing >= 1 are needed")
        self.__dict__.update(target=target, lags=lags, return_lag=return_lag, weight_lag=weight_lag, factor_lag=factor_lag, smoothing=smoothing, high=high, low=low)

    def __call__(self, both: DataFrame) -> DataFrame:
        series = strategy_return(both, self.weight_lag).withColumn("ticker", F.lit("STRATEGY"))
        if self.return_lag > 1:
            vol = rolling.volatility(prices=rolling.returns_to_prices(series), lags=self.lags, return_lag=self.return_lag, factor=252 / self.return_lag)
        else:
            vol = rolling.volatility(returns=series, lags=self.lags)
        factor = _scaled(vol.select("obs_date", F.try_divide(F.lit(float(self.target)), F.col("value")).alias("value")), self.low, self.high, self.factor_lag, 1)
        out = both.join(factor.withColumnRenamed("value", "__k"), "obs_date").withColumn("weight", F.col("weight") * F.col("__k")).drop("__k")
        if self.smoothing > 1:
            out = out.withColumn("weight", guarded(F.avg("weight"), F.col("weight"), by_ticker(), self.smoothing))
        return out


class BetaHedge:
    """Adds a position in the hedge instrument against the strategy's beta. Dates without a position have no weights at all.

    The benchmark counts from the strategy's first date on; its returns are its own, taken as of the strategy's dates. If it doesn't span
    these, the plan fails.
    """

    def __init__(self, benchmark: Panel, ticker: str = "HEDGE", lags=252, return_lag: int = 1, factor_lag: int = 1, smoothing: int = 1, high: float = 999.0, low: float = 0.0):
        _require(factor_lag >= 0 and smoothing >= 1, "factor_lag >= 0 and smoothing >= 1 are needed")
        self.__dict__.update(benchmark=benchmark, ticker=ticker, lags=lags, return_lag=return_lag, factor_lag=factor_lag, smoothing=smoothing, high=high, low=low)

    def over(self, span: Callable[[], Span]) -> "BetaHedge":
        """The hedge with what it needs of a stored benchmark."""
        out = copy.copy(self)
        out.benchmark = cut(self.benchmark, span, 2)
        return out

    def __call__(self, both: DataFrame) -> DataFrame:
        if not isinstance(self.benchmark, DataFrame):
            return self.over(lambda: span_of(both))(both)
        returns = both.select("obs_date", "ticker", F.col("ret").alias("value"))
        dates = both.agg(F.min("obs_date").alias("__begin"), F.max("obs_date").alias("__end"))  # one row, as the next
        own = self.benchmark.where("value is not null").agg(F.min("obs_date").alias("__lo"), F.max("obs_date").alias("__hi"))
        spans = (F.col("__lo") <= F.col("__begin")) & (F.col("__hi") >= F.col("__end"))
        fails = F.raise_error(F.lit("the hedge's prices don't span the strategy's dates")).cast("date")
        begin = dates.crossJoin(own).select(F.when(F.col("__begin").isNull() | F.coalesce(spans, F.lit(False)), F.col("__begin")).otherwise(fails).alias("__begin"))
        bench = self.benchmark.select("obs_date", "value").crossJoin(begin).where(F.col("obs_date") >= F.col("__begin")).drop("__begin")
        if self.return_lag > 1:
            betas = rolling.beta(prices=rolling.returns_to_prices(returns), benchmark=bench, lags=self.lags, return_lag=self.return_lag)
        else:
            betas = rolling.beta(returns=returns, benchmark=bench, lags=self.lags)
        joined = both.join(betas.withColumnRenamed("value", "__b"), ["obs_date", "ticker"], "left")
        series = joined.groupBy("obs_date").agg(strict_sum(F.col("__b") * F.col("weight")).alias("value"))
        short = clean.clip(series, self.low, self.high).withColumn("value", -F.col("value"))
        hedge = _scaled(short, None, None, self.factor_lag, self.smoothing).withColumnRenamed("value", "__h")
        filled = F.last("value", ignorenulls=True).over(last_rows(on_dates(), None))
        moved = bench.withColumn("value", filled).withColumn("ret", F.col("value") / F.lag("value").over(on_dates()) - 1)
        at = asof.calendar_map(both, bench)
        leg = at.join(moved.select(F.col("obs_date").alias("as_of"), "ret"), "as_of", "left").select("obs_date", F.lit(self.ticker).alias("ticker"), "ret")
        leg = leg.join(hedge, "obs_date", "left").withColumnRenamed("__h", "weight")
        masked = both.join(hedge, "obs_date", "left").withColumn("weight", F.when(F.col("__h").isNotNull(), F.col("weight"))).drop("__h")
        return masked.unionByName(leg)


# indices


def index_rebalanced(both: DataFrame, weight_lag: int = 1, transaction_cost: float = 0.0, fee: float = 0.0, initial: float = 100.0) -> DataFrame:
    """Daily rebalanced index of (obs_date, ticker, ret, weight): obs_date, index_return, value.

    A date's return is NULL if any weighted term is. Costs are charged on weight changes, fees by days / 365.
    The row before the first return holds the initial value, earlier rows NULL.
    """
    _require(weight_lag >= 1, "the weight lag is at least 1")
    _require(transaction_cost >= 0, "transaction costs are not negative")
    _require(initial > 0, "the initial value is positive")
    if fee < 0:
        warnings.warn("the fee is negative", stacklevel=2)
    w = by_ticker()
    terms = both.withColumn("__t", F.coalesce("ret", F.lit(0.0)) * F.lag("weight", weight_lag).over(w)).withColumn("__c", F.abs(F.col("weight") - F.lag("weight").over(w)))
    daily = terms.groupBy("obs_date").agg(strict_sum(F.col("__t")).alias("r"), skip_sum(F.col("__c")).alias("__c"))
    if transaction_cost > 0 or fee != 0:
        daily = daily.withColumn("r", F.col("r") - transaction_cost * F.col("__c") - fee * year_fraction(365))
    return levels(daily.select("obs_date", F.col("r").alias("index_return")), initial)


def levels(daily: DataFrame, initial: float = 100.0) -> DataFrame:
    """Compounds ``index_return``."""
    grown = F.product(1 + F.col("index_return")).over(last_rows(on_dates(), None))
    before = F.lead("index_return").over(on_dates()).isNotNull() & (F.count("index_return").over(last_rows(on_dates(), None)) == 0)
    value = F.when(F.col("index_return").isNotNull(), grown * float(initial)).when(before, float(initial))
    return daily.withColumn("value", value)


def index_drifting(prices: DataFrame, weights: DataFrame, transaction_cost: float = 0.0, fee: float = 0.0, initial: float = 100.0) -> DataFrame:
    """Index whose weights drift with prices between rebalances: obs_date, rebalance, value. Fees by days / 360."""
    _require(transaction_cost >= 0, "transaction costs are not negative")
    on = asof.weights_on_prices(prices, weights)
    w = by_ticker()
    base = F.last(F.when(F.col("rebalance") == 1, F.col("price")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    on = on.withColumn("__g", F.lag("weight").over(w) * (F.col("price") / base - 1)).withColumn("__c", F.abs(F.col("weight") - F.lag("weight").over(w)))
    daily = on.groupBy("obs_date").agg(F.max("rebalance").alias("rebalance"), skip_sum(F.col("__g")).alias("g"), skip_sum(F.col("__c")).alias("c"))
    past = on_dates().rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(on_dates()) == 1
    last = F.last(F.when(F.col("rebalance") == 1, F.col("obs_date")), ignorenulls=True).over(past)
    f = F.when(first, F.lit(1.0)).otherwise(1 + F.col("g") - fee * F.datediff("obs_date", last) / 360 - transaction_cost * F.col("c"))
    daily = daily.withColumn("f", f)
    kept = F.coalesce(F.product(F.when((F.col("rebalance") == 1), F.col("f"))).over(past), F.lit(1.0))
    return daily.select("obs_date", "rebalance", (float(initial) * kept * F.col("f")).alias("value"))


def index_hedged(returns: DataFrame, weights: DataFrame, *, transaction_cost: float = 0.0, fee: float = 0.0, smoothing: int = 1, weight_lag: int = 1, initial: float = 100.0, volatility_target: float | None = None, volatility_lags=60, cap: float = 1.0, market: DataFrame | None = None, beta_lags=252, carry: float = 0.0, beta_return_lag: int = 1) -> DataFrame:
    """Gross and net index with optional market hedge and volatility target: obs_date, gross_return, gross, net_return, net."""
    w = by_ticker()
    on = asof.on_calendar(weights, returns).withColumn("weight", F.avg("value").over(last_rows(w, smoothing))).drop("value")
    both = materialized(returns.withColumnRenamed("value", "ret").join(on, ["obs_date", "ticker"], "left").select("obs_date", "ticker", "ret", "weight"), "index")
    returns = both.select("obs_date", "ticker", F.col("ret").alias("value"))
    hedge = None
    if market is not None:
        own = returns if beta_return_lag == 1 else rolling.returns_to_prices(returns)
        betas = rolling.beta(**{"returns" if beta_return_lag == 1 else "prices": own}, benchmark=market, lags=beta_lags, return_lag=beta_return_lag)
        exposure = both.join(betas.withColumnRenamed("value", "__b"), ["obs_date", "ticker"], "left")
        hedge = exposure.groupBy("obs_date").agg((-strict_sum(F.col("__b") * F.col("weight"))).alias("weight"))
        moved = market.withColumn("ret", F.col("value") / F.lag("value").over(on_dates()) - 1)
        m = asof.calendar_map(returns, market)
        leg = m.join(moved.select(F.col("obs_date").alias("as_of"), "ret"), "as_of", "left").select("obs_date", F.lit("MARKET").alias("ticker"), "ret").join(hedge, "obs_date")
        both = both.select("obs_date", "ticker", "ret", "weight").unionByName(leg)
    gross = both.withColumn("__t", F.col("ret") * F.lag("weight", weight_lag).over(w)).groupBy("obs_date").agg(strict_sum(F.col("__t")).alias("gross_return"))
    if volatility_target:
        vol = rolling.volatility(returns=gross.select("obs_date", F.lit("INDEX").alias("ticker"), F.col("gross_return").alias("value")), lags=volatility_lags)
        risky = vol.select("obs_date", F.least(F.try_divide(F.lit(float(volatility_target)), F.col("value")), F.when(F.col("value").isNotNull(), F.lit(float(cap)))).alias("__k"))
        both = both.join(risky, "obs_date").withColumn("weight", F.col("weight") * F.col("__k")).drop("__k")
        gross = both.withColumn("__t", F.col("ret") * F.lag("weight", weight_lag).over(w)).groupBy("obs_date").agg(strict_sum(F.col("__t")).alias("gross_return"))
    turned = both.withColumn("__c", F.abs(F.col("weight") - F.lag("weight").over(w))).groupBy("obs_date").agg(skip_sum(F.col("__c")).alias("__c"))
    days = year_fraction(365)
    net = F.col("gross_return") - transaction_cost * F.col("__c") - fee * days
    out = gross.join(turned, "obs_date")
    if hedge is not None and carry:
        out = out.join(hedge.withColumnRenamed("weight", "__h"), "obs_date", "left")
        net = net + F.lag("__h", weight_lag).over(on_dates()) * days * carry
    out = out.withColumn("net_return", net).select("obs_date", "gross_return", "net_return")
    g = levels(out.select("obs_date", F.col("gross_return").alias("index_return")), initial).select("obs_date", F.col("value").alias("gross"))
    n = levels(out.select("obs_date", F.col("net_return").alias("index_return")), initial).select("obs_date", F.col("value").alias("net"))
    return out.join(g, "obs_date").join(n, "obs_date").select("obs_date", "gross_return", "gross", "net_return", "net")


class Strategy:
    """Signals, a weight, overlays and an index over one basket."""

    def __init__(self, signal: Signal | DataFrame | Sequence[Signal | DataFrame], weight: Callable[[DataFrame], DataFrame], prices: Panel, overlays: Sequence[Callable[[DataFrame], DataFrame]] | Callable | None = None, *, accumulate: str = "union", weight_smoothing: int = 1, weight_lag: int = 2, transaction_cost: float = 0.0, fee: float = 0.0, initial: float = 100.0):
        signals = list(signal) if isinstance(signal, (list, tuple)) else [signal]
        if not signals or not all(isinstance(s, (Signal, DataFrame)) for s in signals):
            raise TypeError("signals are Signals or panels")
        if not callable(weight):
            raise TypeError("the weight is a function of the signal")
        _require(accumulate in ("union", "intersection"), "signals are combined by union or intersection")
        _require(weight_smoothing >= 1 and weight_lag >= 1, "weight_smoothing >= 1 and weight_lag >= 1 are needed")
        _require(transaction_cost >= 0 and initial > 0, "costs are not negative and the initial value is positive")
        self.signals, self.weight, self.prices = signals, weight, prices
        self.overlays = [] if overlays is None else list(overlays) if isinstance(overlays, (list, tuple)) else [overlays]
        if not all(callable(o) for o in self.overlays):
            raise TypeError("overlays are functions of returns and weights")
        self.__dict__.update(accumulate=accumulate, weight_smoothing=weight_smoothing, weight_lag=weight_lag, transaction_cost=transaction_cost, fee=fee, initial=initial)

    def signal(self) -> DataFrame:
        panels = [s.compute() if isinstance(s, Signal) else s for s in self.signals]
        return panels[0] if len(panels) == 1 else cross.combine_signals(panels, self.accumulate)

    def span(self) -> Span:
        """First and last date of the signals."""
        spans = [s.span() if isinstance(s, Signal) else span_of(s) for s in self.signals]
        return min(s[0] for s in spans), max(s[1] for s in spans)

    def weights(self) -> DataFrame:
        weight = self.weight.over(self.span) if isinstance(self.weight, PricedWeight) else self.weight
        return weight(self.signal())

    def returns_and_weights(self, end=None) -> DataFrame:
        """(obs_date, ticker, ret, weight) after the overlays, from the first date with weights on. What overlays read again is written once."""
        w = self.weights()
        if not isinstance(self.prices, DataFrame):  # scans of a store are not repeated in the plan: weights are few, and read three times
            w = materialized(w, "weights")
        first = w.agg(F.min("obs_date").alias("__d"))
        needed = cut(self.prices, lambda: (self.span()[0], end), 2)
        prices = clean.ffill(needed).join(F.broadcast(first), F.col("obs_date") >= F.col("__d")).drop("__d")
        prices = prices.join(w.select("ticker").distinct(), "ticker", "left_semi")
        ret = prices.withColumn("ret", F.try_divide(F.col("value"), F.lag("value").over(by_ticker())) - 1).drop("value")
        on = asof.on_calendar(w, prices).withColumn("weight", F.avg("value").over(last_rows(by_ticker(), self.weight_smoothing))).drop("value")
        both = ret.join(on, ["obs_date", "ticker"], "left").select("obs_date", "ticker", "ret", "weight")
        both = both if end is None else both.where(F.col("obs_date") <= F.lit(end).cast("date"))
        for overlay in self.overlays:
            both = materialized(both, "overlay")
            both = (overlay.over(lambda: (self.span()[0], end)) if isinstance(overlay, BetaHedge) else overlay)(both)
        return both

    def back_test(self, end=None, drop_null: bool = True) -> DataFrame:
        both = self.returns_and_weights(end)
        out = index_rebalanced(both, self.weight_lag, self.transaction_cost, self.fee, self.initial).select("obs_date", "value")
        return out.where("value is not null") if drop_null else out

    def describe_table(self, universe: Universe | None = None, currency: str | None = None, total_return: bool = False, dividend_tax: float = 0.0) -> DataFrame:
        """What the index consists of, as (item, description) rows in order."""

        def many(what: str, parts: list) -> list[tuple[str, str]]:
            names = [getattr(p, "__name__", type(p).__name__) for p in parts]
            return [(f"{what}:", names[0])] if len(parts) == 1 else [(f"{what} ({k + 1}/{len(parts)}):", n) for k, n in enumerate(names)]

        rows = [("Index eligibility:", ", ".join(universe.filters) if universe is not None and universe.filters else "none")]
        rows += [("Currency:", currency.upper() if currency else "Local currency"), ("Return type:", "Total return" if total_return else "Price return")]
        rows += [("Dividend tax:", f"{round(100 * dividend_tax, 2)}%")] if dividend_tax else []
        rows += [("Signal accumulation method:", f"{self.accumulate} of all signals")] if len(self.signals) > 1 else []
        rows += many("Signal", self.signals) + [("Weight:", getattr(self.weight, "__name__", type(self.weight).__name__))] + (many("Overlay", self.overlays) if self.overlays else [])
        rows += [("Index fee p.a.:", f"{round(100 * self.fee, 2)}%"), ("Transaction costs:", f"{round(100 * self.transaction_cost, 2)}%")]
        rows += [("Weight smoothing (days):", str(self.weight_smoothing))] if self.weight_smoothing > 1 else []
        rows += [("Weight observation lag (days):", str(self.weight_lag))]
        return self.signal().sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position int, item string, description string")

    def describe(self) -> list[tuple[str, str]]:
        return [("signals", str(len(self.signals))), ("accumulation", self.accumulate), ("overlays", str(len(self.overlays))), ("weight observation lag", str(self.weight_lag)), ("weight smoothing", str(self.weight_smoothing)), ("transaction cost", f"{self.transaction_cost:g}"), ("fee", f"{self.fee:g}"), ("initial value", f"{self.initial:g}")]


def rolling_mean_variance(returns: DataFrame, window: int, **how) -> DataFrame:
    """Mean-variance weights from the ``window`` rows before each date; equal weights on the first ``window`` dates."""
    dates = sliding.numbered(returns)
    n = dates.count()
    _require(2 <= window <= n, f"the window lies between 2 and {n}")
    ends = dates.where(F.col("no") > window).select(F.col("obs_date").alias("slice_date"), (F.col("no") - 1).alias("end"))
    top = how.get("max_total", 1.0)
    solved = sliding.solved(returns, dates, ends, None, window, lambda x, cov, start: optimize.mean_variance(x.mean(axis=0), cov, sliding.inside(start, top), **how))
    share = F.lit(1.0) / F.count(F.lit(1)).over(by_date())
    start = returns.join(dates.where(F.col("no") <= window).select("obs_date"), "obs_date", "left_semi").select("obs_date", "ticker", share.alias("value"))
    return start.unionByName(solved.withColumnRenamed("weight", "value"))


def portfolios(returns: DataFrame, calendar: DataFrame, window: int, make: Callable[[np.ndarray, np.ndarray], np.ndarray], factor: float = 252) -> DataFrame:
    """obs_date, no, ticker, weight, mean, volatility: on each date of the calendar, from the ``window``-th return on, the portfolios that ``make``
    gives for the means and covariance of the last ``window`` returns, a row of weights each, with their mean return and annual volatility."""
    _require(window >= 2, "the window is at least 2")
    dates = sliding.numbered(returns)
    at = asof.calendar_map(calendar, returns).where("as_of is not null").select(F.col("obs_date").alias("slice_date"), F.col("as_of").alias("obs_date"))
    ends = at.join(dates, "obs_date").where(F.col("no") >= window).select("slice_date", F.col("no").alias("end"))
    return sliding.portfolios(returns, dates, ends, window, make, factor)


def efficient_frontiers(returns: DataFrame, calendar: DataFrame, window: int, low=0.0, high=1.0, factor: float = 252) -> DataFrame:
    """obs_date, corner, ticker, weight, mean, volatility: the corners of each date's frontier under bounds, from the greatest return (0) to the least variance.

    Between two neighbouring corners every blend of them is efficient, and nothing else is.
    """
    return portfolios(returns, calendar, window, lambda means, cov: optimize.corner_portfolios(means, cov, low, high), factor).withColumnRenamed("no", "corner")


def frontier_blends(returns: DataFrame, calendar: DataFrame, window: int, allocation: float = 1.0, points: int = 50, factor: float = 252) -> DataFrame:
    """obs_date, point, ticker, weight, mean, volatility: each date's frontier without bounds, as blends of the portfolios of least variance and greatest return."""
    make = lambda means, cov: np.array([w for _, w, _, _ in optimize.efficient_frontier(means, cov, allocation, points)])
    return portfolios(returns, calendar, window, make, factor).withColumnRenamed("no", "point")
