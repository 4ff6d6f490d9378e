"""Dates: business days, observation calendars, day counts and futures month codes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The futures month codes, January to December.
MONTH_CODES = ("F", "G", "H", "J", "K", "M", "N", "Q", "U", "V", "X", "Z")

_STEPS = {"D": "1 day", "W": "7 days", "M": "1 month", "BM": "1 month", "Q": "3 months", "A": "12 months"}


def business_shift(date: Column, n: int) -> Column:
    """``n`` business days later (earlier if negative). A weekend counts as the Friday before it going forward and as the
    Monday after it going back, so that one step leads to the next business day either way."""
    day = F.weekday(date)
    if n == 0:
        return F.when(day >= 5, F.date_add(date, 7 - day)).otherwise(date)
    if n > 0:
        anchor = F.when(day >= 5, F.date_sub(date, day - 4)).otherwise(date)
        at = F.least(day, F.lit(4))
        return F.date_add(anchor, F.lit(n) + F.floor((at + n) / 5).cast("int") * 2)
    anchor = F.when(day >= 5, F.date_add(date, 7 - day)).otherwise(date)
    back = -n
    at = F.when(day >= 5, 0).otherwise(day)
    return F.date_sub(anchor, F.lit(back) + F.floor((F.lit(4) - at + back) / 5).cast("int") * 2)


def business_shift_py(date: dt.date, n: int) -> dt.date:
    step = 1 if n > 0 else -1
    left = abs(n)
    while left or date.weekday() > 4:
        date += dt.timedelta(days=step)
        if date.weekday() < 5 and left:
            left -= 1
    return date


def date_range(spark: SparkSession, start: str | None = None, end: str | None = None, periods: int | None = None, freq: str = "D") -> DataFrame:
    """Observation calendar. freq is D, B (business days), W, M (month ends), BM (business month ends), Q or A; a prefix number multiplies it."""
    if sum(x is not None for x in (start, end, periods)) != 2:
        raise ValueError("give two of start, end and periods")
    if freq == "B":
        base = business_days(spark, start, end, periods)
        return base
    unit = freq.lstrip("0123456789")
    times = int(freq[: len(freq) - len(unit)] or 1)
    if unit not in _STEPS:
        raise ValueError(f"{freq} is no frequency")
    n, step = _STEPS[unit].split()
    step = f"interval {int(n) * times} {step}"
    ends = unit in ("M", "BM", "Q", "A")
    if end is None:
        seq = f"transform(sequence(0, {periods - 1}), i -> to_date('{start}') + i * {step})"
    elif start is None:
        seq = f"transform(sequence(0, {periods - 1}), i -> to_date('{end}') - i * {step})"
    else:
        seq = f"sequence(to_date('{start}'), to_date('{end}'), {step})"
    out = spark.range(1).select(F.explode(F.expr(seq)).alias("obs_date")).select(F.col("obs_date").cast("date").alias("obs_date"))
    if ends:
        out = out.select(F.last_day("obs_date").alias("obs_date"))
        if unit == "BM":
            out = out.select(last_business_day("obs_date").alias("obs_date"))
        if end is not None:
            out = out.where(F.col("obs_date") <= F.lit(end).cast("date"))
    return out.distinct().orderBy("obs_date")


def business_days(spark: SparkSession, start: str | None, end: str | None, periods: int | None = None) -> DataFrame:
    if end is None:
        end = business_shift_py(dt.date.fromisoformat(start), periods).isoformat()
    elif start is None:
        start = business_shift_py(dt.date.fromisoformat(end), -periods).isoformat()
    days = spark.range(1).select(F.explode(F.expr(f"sequence(to_date('{start}'), to_date('{end}'))")).alias("obs_date")).where(F.weekday("obs_date") < 5)
    return days.orderBy("obs_date").limit(periods) if periods and end is None else days.orderBy("obs_date")


def last_business_day(col: str) -> Column:
    """The last weekday of the date's month."""
    end = F.last_day(col)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def monotonic(calendar: DataFrame) -> DataFrame:
    """The calendar itself; an error if dates repeat or are missing. Order is a matter of windows, not of rows."""
    if calendar.where("obs_date is null").take(1) or calendar.groupBy("obs_date").count().where("count > 1").take(1):
        raise ValueError("a calendar holds each date once and no NULL")
    return calendar


def year_fraction(days: int, w=None, col: str = "obs_date") -> Column:
    """Days since the row before over ``days`` (360 or 365); NULL on the first row."""
    w = w or Window.orderBy(col)
    return F.datediff(F.col(col), F.lag(col).over(w)) / days


def month_code(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in MONTH_CODES]), F.month(date))


def latest_business_day(today: dt.date | None = None) -> dt.date:
    today = today or dt.date.today()
    return today - dt.timedelta(days=max(0, today.weekday() - 4))
