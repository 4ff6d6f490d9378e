"""Risk and return reports and monthly tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import drop_incomplete_dates
from ..operators.frames import by_ticker, guarded, last_rows
from ..sources import readers, xlsx

# Month names in order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
YEAR = 252


def _prepared(prices: DataFrame, start=None, end=None, normalize: bool = True) -> DataFrame:
    p = drop_incomplete_dates(prices)
    p = p if start is None else p.where(F.col("obs_date") >= F.lit(start).cast("date"))
    p = p if end is None else p.where(F.col("obs_date") <= F.lit(end).cast("date"))
    if normalize:
        p = p.withColumn("value", 100 * F.col("value") / F.first("value").over(last_rows(by_ticker(), None)))
    return p


def rolling_statistics(prices: DataFrame, window: int = YEAR) -> DataFrame:
    """obs_date, ticker, price, annual_return, annual_volatility, drawdown."""
    w = by_ticker()
    p = prices.withColumnRenamed("value", "price").withColumn("__r", F.col("price") / F.lag("price").over(w) - 1)
    return p.select(
        "obs_date",
        "ticker",
        "price",
        (F.col("price") / F.lag("price", window).over(w) - 1).alias("annual_return"),
        (guarded(F.stddev_samp("__r"), F.col("__r"), w, window) * math.sqrt(YEAR)).alias("annual_volatility"),
        (F.col("price") / F.max("price").over(last_rows(w, window)) - 1).alias("drawdown"),
        (F.col("price") / F.max("price").over(last_rows(w, None)) - 1).alias("full_drawdown"),
    )


def risk_and_return(prices: DataFrame, benchmark: str | None = None, start=None, end=None, normalize: bool = True, window: int = YEAR, own_tables: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The report's tables by name. With a benchmark there are exactly two tickers.

    "Return tables" holds the monthly tables of all tickers; those of ``own_tables`` also have sheets of their own.
    """
    if benchmark is not None:
        tickers = [r[0] for r in prices.select("ticker").distinct().limit(3).collect()]
        if len(tickers) != 2 or benchmark not in tickers:
            raise ValueError("a benchmark analysis needs exactly two tickers")
    p = _prepared(prices, start, end, normalize)
    stats = rolling_statistics(p, window)
    summary = stats.groupBy("ticker").agg(F.avg("annual_return").alias("mean_return"), F.avg("annual_volatility").alias("mean_volatility"), F.min("full_drawdown").alias("maximum_drawdown"))
    summary = summary.withColumn("sharpe", F.try_divide("mean_return", "mean_volatility"))
    out = {"Performance": p.select("obs_date", "ticker", "value"), "Risk and return": summary}
    for name, col in (("Rolling 1Y return", "annual_return"), ("Rolling 1Y volatility", "annual_volatility"), ("Rolling 1Y drawdown", "drawdown")):
        out[name] = stats.select("obs_date", "ticker", F.col(col).alias("value"))
    if benchmark is not None:
        active = active_returns(stats, [t for t in tickers if t != benchmark][0], benchmark, window)
        out["Rolling 1Y active returns"] = active.select("obs_date", F.col("active_return").alias("value"))
        out["Rolling 1Y information ratio"] = active.select("obs_date", F.col("information_ratio").alias("value"))
    out["Return tables"] = monthly_table(p)
    for t in own_tables:
        out[f"Return table ({t})"] = out["Return tables"].where(F.col("ticker") == t)
    return out


def active_returns(stats: DataFrame, ticker: str, benchmark: str, window: int = YEAR) -> DataFrame:
    """Annual return less the benchmark's, and over its rolling standard deviation."""
    own = F.max(F.when(F.col("ticker") == ticker, F.col("annual_return")))
    other = F.max(F.when(F.col("ticker") == benchmark, F.col("annual_return")))
    a = stats.groupBy("obs_date").agg((own - other).alias("active_return"))
    w = Window.orderBy("obs_date")
    return a.withColumn("information_ratio", F.try_divide(F.col("active_return"), guarded(F.stddev_samp("active_return"), F.col("active_return"), w, window)))


def monthly_returns(prices: DataFrame, include_first: bool = True) -> DataFrame:
    """ticker, year, month, value: change between the last prices of months; the first month against its first price."""
    filled = prices.where("value is not null")
    ends = filled.groupBy("ticker", F.year("obs_date").alias("year"), F.month("obs_date").alias("month")).agg(F.max_by("value", "obs_date").alias("__end"), F.min_by("value", "obs_date").alias("__first"))
    w = Window.partitionBy("ticker").orderBy("year", "month")
    before = F.lag("__end").over(w)
    change = F.when(before.isNull(), F.col("__end") / F.col("__first") - 1 if include_first else F.lit(None)).otherwise(F.col("__end") / before - 1)
    return ends.select("ticker", "year", "month", change.alias("value"))


def monthly_table(prices: DataFrame, include_first: bool = True) -> DataFrame:
    """One row per ticker and year with the months' returns and the year's."""
    m = monthly_returns(prices, include_first).withColumn("__m", F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.col("month")))
    year = m.groupBy("ticker", "year").agg((F.product(1 + F.col("value")) - 1).alias("yearly_return"))
    return m.groupBy("ticker", "year").pivot("__m", list(MONTHS)).agg(F.first("value")).join(year, ["ticker", "year"])



def report_of_sheet(spark: SparkSession, folder: str, sheet: str, out: str, benchmark: str | None = None, window: int = YEAR) -> dict[str, DataFrame]:
    """The report of index levels that stand in a sheet, dates by tickers, as they are; written to ``out``, a folder or a workbook."""
    wide = readers.read_sheet(spark, folder, sheet)
    if wide is None:
        raise ValueError(f"{sheet} has no rows")
    typed = wide.select(xlsx.as_date(F.col(f"`{wide.columns[0]}`").cast("string")).alias("obs_date"), *[F.col(f"`{c}`").try_cast("double").alias(c.upper()) for c in wide.columns[1:]])
    levels = typed.unpivot(["obs_date"], typed.columns[1:], "ticker", "value")
    tables = risk_and_return(levels, benchmark, normalize=False, window=window)
    readers.write_report(tables, out)
    return tables
