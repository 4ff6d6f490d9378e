"""Histories of membership: daily members folded into stretches and back, cut to a frequency, and kept as sheets.

A stretch (ticker, start, end) is a run of dates of a calendar on which a ticker is a member; a calendar is numbered once, one row per date, and
everything else is an equi-join or a window by ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import read_sheet, write_report

#: What a frequency keeps: the last date of each day, week, month, quarter or year of the calendar.
FREQUENCIES = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _numbered(calendar: DataFrame) -> DataFrame:
    return calendar.select("obs_date").distinct().withColumn("no", F.row_number().over(Window.orderBy("obs_date")))


def stretches(members: DataFrame, calendar: DataFrame) -> DataFrame:
    """(obs_date, ticker) rows as ticker, start, end: the runs of the calendar's dates without a gap."""
    own = members.select("obs_date", F.upper("ticker").alias("ticker")).distinct().join(_numbered(calendar), "obs_date")
    run = F.col("no") - F.row_number().over(Window.partitionBy("ticker").orderBy("no"))
    return own.withColumn("run", run).groupBy("ticker", "run").agg(F.min("obs_date").alias("start"), F.max("obs_date").alias("end")).select("ticker", "start", "end")


def daily(runs: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stretches as obs_date, ticker rows of a calendar, which may be another one. Overlapping stretches count once."""
    dates = _numbered(calendar)
    # each end of a stretch as of the calendar: the number of the last date up to it
    ends = runs.select(F.upper("ticker").alias("ticker"), "start", "end").distinct().withColumn("run", F.monotonically_increasing_id())
    marks = ends.select("run", F.explode(F.array(F.struct(F.date_sub("start", 1).alias("at"), F.lit(True).alias("first")), F.struct(F.col("end").alias("at"), F.lit(False).alias("first")))).alias("m"))
    wanted = marks.select("m.at").distinct()
    known = dates.select(F.col("obs_date").alias("at"), "no").unionByName(wanted.withColumn("no", F.lit(None).cast("int")))
    upto = known.groupBy("at").agg(F.max("no").alias("no")).withColumn("upto", F.coalesce(F.last("no", ignorenulls=True).over(Window.orderBy("at")), F.lit(0)))
    placed = marks.select("run", F.col("m.at").alias("at"), "m.first").join(upto.select("at", "upto"), "at")
    bounds = placed.groupBy("run").agg(F.max(F.when(F.col("first"), F.col("upto") + 1)).alias("lo"), F.max(F.when(~F.col("first"), F.col("upto"))).alias("hi")).where("lo <= hi")
    each = ends.select("run", "ticker").join(bounds, "run").select("ticker", F.explode(F.sequence("lo", "hi")).alias("no"))
    return each.join(dates, "no").select("obs_date", "ticker").distinct()


def at_frequency(calendar: DataFrame, freq: str) -> DataFrame:
    """The last date of each of the calendar's days (D), weeks (W), months (M), quarters (Q) or years (Y)."""
    if freq.upper() not in FREQUENCIES:
        raise ValueError(f"the frequency is one of {', '.join(FREQUENCIES)}")
    return calendar.groupBy(F.date_trunc(FREQUENCIES[freq.upper()], "obs_date")).agg(F.max("obs_date").alias("obs_date")).select("obs_date")


def inclusion(runs: DataFrame, calendar: DataFrame, freq: str = "D") -> DataFrame:
    """obs_date, ticker, value: 1 or 0 on the calendar's dates at a frequency, from the first one with any member on."""
    dates = at_frequency(calendar, freq)
    own = daily(runs, dates).withColumn("value", F.lit(1.0))
    first = own.agg(F.min("obs_date").alias("first"))
    grid = dates.join(F.broadcast(first), F.col("obs_date") >= F.col("first")).select("obs_date").crossJoin(own.select("ticker").distinct())
    return grid.join(own, ["obs_date", "ticker"], "left").select("obs_date", "ticker", F.coalesce("value", F.lit(0.0)).alias("value"))


def export(runs: DataFrame, calendar: DataFrame, folder: str, freq: str = "D", format: str = "parquet") -> None:
    """Sheets ``index_members`` (dates by tickers, 1 or 0) and ``tickers`` in a folder or a workbook."""
    panel = inclusion(runs, calendar, freq)
    names = [r[0] for r in panel.select("ticker").distinct().orderBy("ticker").collect()]  # the sheet's columns
    wide = panel.groupBy("obs_date").pivot("ticker", names).agg(F.first("value")).orderBy("obs_date")
    write_report({"index_members": wide, "tickers": panel.select("ticker").distinct().orderBy("ticker")}, folder, format)


def load_eligibility(spark: SparkSession, folder: str, sheet: str = "index_members", format: str = "parquet") -> DataFrame:
    """A sheet of dates by tickers, as ``export`` writes it or by hand, as a panel for ``Universe.custom``: 1, 0 or NULL."""
    wide = read_sheet(spark, folder, sheet, format)
    dated = wide.withColumnRenamed(wide.columns[0], "obs_date").withColumn("obs_date", F.to_date(F.col("obs_date").cast("string")))
    typed = dated.select("obs_date", *[F.col(f"`{c}`").cast("double").alias(c) for c in dated.columns if c != "obs_date"])
    panel = typed.unpivot(["obs_date"], [c for c in typed.columns if c != "obs_date"], "ticker", "value").withColumn("ticker", F.upper("ticker"))
    bad = F.col("value").isNotNull() & ~F.col("value").isin(0.0, 1.0)
    return panel.withColumn("value", F.when(bad, F.raise_error(F.lit("eligibility is 1, 0 or missing")).cast("double")).otherwise(F.col("value")))
