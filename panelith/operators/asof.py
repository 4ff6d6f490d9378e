"""As-of joins: the last row at or before a date.

The dates of both sides are united and the right side's last date is carried along one window; an equi-join fetches the row. With
keys the window runs per key; without them it runs over the two calendars alone, whose length is the number of dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_map(left: DataFrame, right: DataFrame, date_col: str = "obs_date", keys: Sequence[str] = ()) -> DataFrame:
    """Keys, each left date and ``as_of``, the last right date at or before it (NULL if none)."""
    keys = list(keys)
    a = left.select(*keys, F.col(date_col).alias("d"), F.lit(1).alias("side")).distinct()
    b = right.select(*keys, F.col(date_col).alias("d"), F.lit(0).alias("side")).distinct()
    w = Window.partitionBy(*keys).orderBy("d", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("as_of", F.last(F.when(F.col("side") == 0, F.col("d")), ignorenulls=True).over(w))
    return both.where("side = 1").select(*keys, F.col("d").alias(date_col), "as_of")


def merge_as_of(left: DataFrame, right: DataFrame, date_col: str = "obs_date", suffix: str = "_x") -> DataFrame:
    """Left rows with the columns of the latest right row at or before their date; left columns that clash get the suffix.

    The whole row is taken, its NULLs included. The right side has one row per date.
    """
    clash = (set(left.columns) & set(right.columns)) - {date_col}
    a = left.select(date_col, *[F.col(f"`{c}`").alias(f"{c}{suffix}" if c in clash else c) for c in left.columns if c != date_col])
    m = calendar_map(left, right, date_col)
    return a.join(m, date_col).join(right.withColumnRenamed(date_col, "as_of"), "as_of", "left").drop("as_of")


def on_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """A dense panel on other dates: each has the panel's row at or before it; earlier dates have NULL for every ticker."""
    m = calendar_map(calendar, panel)
    tickers = panel.select("ticker").distinct()
    grid = m.crossJoin(tickers)
    return grid.join(panel.withColumnRenamed("obs_date", "as_of"), ["as_of", "ticker"], "left").drop("as_of")


def per_ticker(left: DataFrame, right: DataFrame, value: str = "value", alias: str = "as_of_value") -> DataFrame:
    """Left rows with the right side's last value of the same ticker at or before their date."""
    m = calendar_map(left, right, keys=["ticker"])
    picked = m.join(right.select("ticker", F.col("obs_date").alias("as_of"), F.col(value).alias(alias)), ["ticker", "as_of"], "left").drop("as_of")
    return left.join(picked, ["ticker", "obs_date"], "left")


def trailing_slices(panel: DataFrame, calendar: DataFrame, n: int | None) -> DataFrame:
    """Per date of the calendar the last n dates of the panel up to it (all for None): slice_date, obs_date, ticker, value.

    Dates are numbered once; each one fans out to the slices that hold it, so the join stays an equi-join.
    """
    w = Window.orderBy("obs_date")  # one row per date
    numbered = panel.select("obs_date").distinct().withColumn("no", F.row_number().over(w))
    m = calendar_map(calendar, panel).where("as_of is not null").select(F.col("obs_date").alias("slice_date"), F.col("as_of").alias("obs_date"))
    ends = m.join(numbered, "obs_date").select("slice_date", F.col("no").alias("end"))
    first = F.lit(1) if n is None else F.greatest(F.lit(1), F.col("end") - n + 1)
    held = ends.select("slice_date", F.explode(F.sequence(first, F.col("end"))).alias("no"))
    return held.join(numbered, "no").drop("no").join(panel, "obs_date")


def weights_on_prices(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """Dense prices with the weights as of each date; rebalance is 1 where the weight row changes and on the first row.

    Prices are filled forward; dates before the first weights go. Both sides need the same tickers.
    """
    from .clean import ffill

    odd = prices.select("ticker").distinct().join(weights.select("ticker").distinct().withColumn("w", F.lit(1)), "ticker", "full").where("w is null").take(1)
    more = weights.select("ticker").distinct().join(prices.select("ticker").distinct(), "ticker", "left_anti").take(1)
    if odd or more:
        raise ValueError("prices and weights need the same tickers")
    filled = ffill(prices.select("obs_date", "ticker", F.col("value").alias("price")), "price")
    m = calendar_map(prices, weights).where("as_of is not null")
    changed = F.col("as_of") != F.lag("as_of").over(Window.orderBy("obs_date"))  # one row per date
    m = m.withColumn("rebalance", F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0))
    return filled.join(m, "obs_date").join(weights.select(F.col("obs_date").alias("as_of"), "ticker", F.col("value").alias("weight")), ["as_of", "ticker"], "left").drop("as_of")
