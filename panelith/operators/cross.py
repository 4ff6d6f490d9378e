"""Cross-sections: filters, ranks and aggregates over the tickers of a date, and checks of panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, gram
from .frames import by_date

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def winsorize(panel: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """NULL outside the date's interpolated quantiles."""
    if not low < high:
        raise ValueError("low < high is needed")
    q = F.expr(f"percentile(value, array({float(low)!r}D, {float(high)!r}D))").over(by_date())
    inside = (F.col("value") >= F.col("__q")[0]) & (F.col("value") <= F.col("__q")[1])
    return panel.withColumn("__q", q).withColumn("value", F.when(inside, F.col("value"))).drop("__q")


def first_rank(ascending: bool = True) -> Column:
    """Rank of the values of a date; ties in order of ticker either way; NULL for NULL."""
    order = F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value")
    return F.when(F.col("value").isNotNull(), F.row_number().over(by_date(order, "ticker")))


def _limit(threshold: int | float, counted: str = "value") -> Column:
    """A number of tickers, or a fraction of the date's values rounded half to even."""
    if isinstance(threshold, float):
        return F.rint(F.count(counted).over(by_date()) * threshold)
    return F.lit(threshold)


def rank_filter(panel: DataFrame, ascending: bool, inclusive: bool, threshold: int | float) -> DataFrame:
    """1 for the first tickers of each date by rank (or for the others), else NULL. An int counts tickers, a float is a fraction."""
    if threshold <= 0 or isinstance(threshold, float) and threshold > 1:
        raise ValueError("the threshold is positive, and at most 1 if a fraction")
    inside = F.col("__rank") <= _limit(threshold)
    return panel.withColumn("__rank", first_rank(ascending)).withColumn("value", F.when(inside if inclusive else ~inside, 1.0)).drop("__rank")


def top_k(panel: DataFrame, eligibility: DataFrame, *, number: int | None = None, fraction: float | None = None, ascending: bool = False, include: bool = True, drop_best_number: int | None = None, drop_best_fraction: float | None = None) -> DataFrame:
    """Signal 1 for the first-ranked eligible tickers of each date (or for the rest).

    ``drop_best`` takes the lowest rank numbers away before the rest is ranked anew.
    """
    if (number is None) == (fraction is None):
        raise ValueError("give either number or fraction")
    if number is not None and number < 1 or fraction is not None and not 0 < fraction < 1:
        raise ValueError("number is at least 1, fraction lies between 0 and 1")
    if drop_best_number is not None and drop_best_fraction is not None:
        raise ValueError("give one of drop_best_number and drop_best_fraction")
    on = asof.on_calendar(panel, eligibility).join(eligibility.select("obs_date", "ticker", F.col("value").alias("__e")), ["obs_date", "ticker"])
    ranked = on.withColumn("value", F.col("value") * F.col("__e")).drop("__e")
    ranked = ranked.withColumn("value", first_rank(ascending).cast("double"))
    best = drop_best_number if drop_best_number is not None else drop_best_fraction
    if best is not None:
        ranked = ranked.withColumn("value", F.when(F.col("value") > _limit(best), F.col("value")))
        ranked = ranked.withColumn("value", first_rank(True).cast("double"))
    inside = F.col("value") <= _limit(number if number is not None else float(fraction))
    return ranked.withColumn("value", F.when(inside if include else ~inside, 1.0))


def aggregate(panels: Sequence[DataFrame], how: str) -> DataFrame:
    """Greatest, least or mean of several panels cell by cell; NULL if any is."""
    aggs = {"max": F.max, "min": F.min, "avg": F.avg}
    if how not in aggs:
        raise ValueError("the panels are combined by max, min or avg")
    whole = reduce(DataFrame.unionByName, [p.select("obs_date", "ticker", "value") for p in panels])
    return whole.groupBy("obs_date", "ticker").agg(F.when(F.count("value") == len(panels), aggs[how]("value")).alias("value"))


def combine_signals(signals: Sequence[DataFrame], how: str) -> DataFrame:
    """Union: greatest value, missing ones skipped. Intersection: product, NULL if any is."""
    if how not in ("union", "intersection"):
        raise ValueError("signals are combined by union or intersection")
    whole = reduce(DataFrame.unionByName, [s.select("obs_date", "ticker", "value") for s in signals])
    value = F.max("value") if how == "union" else F.when(F.count("value") == len(signals), F.product("value"))
    return whole.groupBy("obs_date", "ticker").agg(value.alias("value"))


def weekday(name: str) -> int:
    """0 for Monday."""
    if name.lower() not in WEEKDAYS:
        raise ValueError(f"{name} is no weekday")
    return WEEKDAYS.index(name.lower())


def frequency_filter(panel: DataFrame, freq: int | str | None) -> DataFrame:
    """A weekday's rows, or every n-th date counted back from the latest."""
    if freq is not None and (isinstance(freq, bool) or not isinstance(freq, (int, str))):
        raise TypeError("the frequency is None, a whole number or a weekday's name")
    if freq is None or freq == 1:
        return panel
    if isinstance(freq, str):
        return panel.where(F.weekday("obs_date") == weekday(freq))
    if freq < 1:
        raise ValueError("the frequency is at least 1")
    dates = panel.select("obs_date").distinct().withColumn("__n", F.row_number().over(Window.orderBy(F.desc("obs_date"))) - 1)
    return panel.join(dates.where(F.col("__n") % freq == 0).select("obs_date"), "obs_date")


def annualization_factor(freq: int | str | None) -> float:
    return 252 / (5 if isinstance(freq, str) else freq or 1)


def pairwise_correlation(panel: DataFrame) -> DataFrame:
    """Pearson correlation of every two tickers over the dates that both have: ticker_1, ticker_2, value."""
    return gram.moments(panel.where("value is not null"), []).where("n > 0").select("ticker_1", "ticker_2", gram.correlation().alias("value"))


def covariance(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sample covariance of every two tickers, per key: NULL if either lacks a value on any date that both have a row of."""
    keys = list(keys)
    met = gram.moments(panel, keys).where("rows > 0")
    return met.select(*keys, "ticker_1", "ticker_2", F.when(F.col("n") == F.col("rows"), gram.covariance()).alias("value"))


def mean(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return panel.groupBy(*keys, "ticker").agg(F.avg("value").alias("value"))


def describe(panel: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, quartiles and range per ticker."""
    q = F.expr("percentile(value, array(0.25D, 0.5D, 0.75D))")
    out = panel.groupBy("ticker").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), q.alias("q"), F.max("value").alias("greatest"))
    return out.select("ticker", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "greatest")


def only_values(panel: DataFrame, *allowed) -> bool:
    """Whether every value that is there is one of the allowed."""
    return not panel.where(F.col("value").isNotNull() & ~F.col("value").isin(*allowed)).take(1)


def distinct_values(panel: DataFrame) -> DataFrame:
    return panel.select("value").distinct()


def same_shape(a: DataFrame, b: DataFrame) -> bool:
    """Whether two panels have the same dates and tickers."""
    keys = ["obs_date", "ticker"]
    x, y = a.select(*keys), b.select(*keys)
    return not x.join(y, keys, "left_anti").take(1) and not y.join(x, keys, "left_anti").take(1)


def same_index(panels: Sequence[DataFrame]) -> None:
    if not all(same_shape(panels[0], p) for p in panels[1:]):
        raise ValueError("the panels differ in dates or tickers")


def all_equal(panel: DataFrame) -> bool:
    return panel.agg(F.count_distinct("value")).first()[0] <= 1
