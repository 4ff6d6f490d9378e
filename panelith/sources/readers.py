"""Sources of facts and instruments: anything that yields long DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.frames import no_nan
from . import xlsx
from .shared import materialized

FIELDS = ("open", "high", "low", "close", "volume", "dividend", "split")
FACTS = "obs_date date, ticker string, field string, value double"


def among(rows: DataFrame, tickers: Sequence[str] | DataFrame) -> DataFrame:
    """The rows of the tickers, given as a list or as a table."""
    if isinstance(tickers, DataFrame):
        return rows.join(tickers.select(F.upper("ticker").alias("ticker")), "ticker", "left_semi")
    return rows.where(F.col("ticker").isin([t.upper() for t in tickers]))


class Source(Protocol):
    """What a vendor connection provides."""

    def facts(self, spark: SparkSession, tickers: Sequence[str], start=None, end=None) -> DataFrame:
        """obs_date, ticker, field, value."""

    def instruments(self, spark: SparkSession, tickers: Sequence[str]) -> DataFrame:
        """ticker and its attributes."""


class FrameSource:
    """A source over DataFrames that are already there."""

    def __init__(self, facts: DataFrame, instruments: DataFrame, index_members: DataFrame | None = None, chains: DataFrame | None = None):
        self._facts, self._instruments, self._members, self._chains = facts, instruments, index_members, chains

    def facts(self, spark: SparkSession, tickers: Sequence[str], start=None, end=None) -> DataFrame:
        out = among(self._facts, tickers)
        out = out if start is None else out.where(F.col("obs_date") >= F.lit(start).cast("date"))
        out = out if end is None else out.where(F.col("obs_date") <= F.lit(end).cast("date"))
        value = F.when(F.col("field").isin("dividend", "split"), F.nullif(no_nan("value"), F.lit(0.0))).otherwise(no_nan("value"))
        return out.select("obs_date", "ticker", "field", value.alias("value")).where("value is not null")

    def instruments(self, spark: SparkSession, tickers: Sequence[str]) -> DataFrame:
        return among(self._instruments, tickers)

    def index_members(self, index_ticker: str) -> DataFrame:
        return self._members.where(F.col("index_ticker") == index_ticker.upper())

    def futures_chain(self, generic: str, as_of: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """The contracts of a generic ticker, or, on the dates of a calendar, its n-th live contracts (see ``plans.futures.chain_on``)."""
        own = self._chains.where(F.upper("generic") == generic.upper())
        if as_of is None:
            return own
        from ..plans.futures import chain_on

        return chain_on(own, as_of, most)


class WorkbookSource:
    """An .xlsx file, or a folder with one CSV or Parquet table per sheet: ``underlying`` and wide tables of the fields (dates by tickers)."""

    SHEETS = {"open": "open_price", "high": "high_price", "low": "low_price", "close": "close_price", "volume": "volume", "dividend": "dividend"}

    def __init__(self, folder: str, format: str = "csv"):
        self.folder, self.format = folder, format
        self._cells: DataFrame | None = None

    def sheet(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The table, or None if it is missing or empty."""
        if self.folder.endswith(".xlsx"):
            if self._cells is None:  # the file is parsed once for all sheets
                self._cells = materialized(xlsx.read_cells(spark, self.folder), "cells")
            return xlsx.read_sheet(self._cells, name)
        from pyspark.errors import AnalysisException

        reader = spark.read.option("header", True) if self.format == "csv" else spark.read
        try:
            out = reader.format(self.format).load(f"{self.folder}/{text.sheet_name(name)}.{self.format}")
        except AnalysisException:
            return None
        return out if out.columns and out.take(1) else None

    def facts(self, spark: SparkSession, tickers: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
        out = None
        for field, name in self.SHEETS.items():
            wide = self.sheet(spark, name)
            if wide is None:
                continue
            date = wide.columns[0]
            typed = wide.select(xlsx.as_date(F.col(f"`{date}`").cast("string")).alias("obs_date"), *[F.col(f"`{c}`").try_cast("double").alias(c.upper()) for c in wide.columns[1:]])
            if typed.where("obs_date is null").take(1) or typed.groupBy("obs_date").count().where("count > 1").take(1):
                raise ValueError(f"{name} needs one row per date")
            rows = typed.unpivot(["obs_date"], typed.columns[1:], "ticker", "value").select("obs_date", "ticker", F.lit(field).alias("field"), no_nan("value").alias("value"))
            rows = rows.where("value <> 0") if field == "dividend" else rows.where("value is not null")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError(f"{self.folder} has no sheet with data")
        out = out if tickers is None else among(out, tickers)
        out = out if start is None else out.where(F.col("obs_date") >= F.lit(start).cast("date"))
        return out if end is None else out.where(F.col("obs_date") <= F.lit(end).cast("date"))

    def instruments(self, spark: SparkSession, tickers: Sequence[str] | None = None) -> DataFrame:
        raw = self.sheet(spark, "underlying")
        if raw is None:
            raise ValueError(f"{self.folder} has no underlying sheet")
        free = {"ticker", "description", "website", "address", "short_name", "long_name", "first_ex_div_date", "has_dividend_history"}
        cols = [F.upper(F.col("ticker")).alias("ticker")]
        cols += [F.coalesce(F.col(c) if c in free else text.attribute(F.col(c)), F.lit("NA")).alias(c) for c in raw.columns if c != "ticker"]
        out = raw.select(*cols).dropDuplicates(["ticker"])
        return out if tickers is None else among(out, tickers)


def html_links(pages: DataFrame, pattern: str = r'<a href="/([^"]*)"[^>]*>([^<]*)</a>') -> DataFrame:
    """A ticker and a name per anchor of scraped pages: page_id, ticker, name."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("n"))
    return pages.select("page_id", F.explode(both).alias("x")).select("page_id", F.col("x.t").alias("ticker"), F.col("x.n").alias("name"))


def tidy_dividends(rows: DataFrame, start=None, end=None) -> DataFrame:
    """Dividends of one ex-date are added up."""
    out = rows if start is None else rows.where(F.col("obs_date") >= F.lit(start).cast("date"))
    out = out if end is None else out.where(F.col("obs_date") <= F.lit(end).cast("date"))
    return out.groupBy("obs_date", "ticker").agg(F.sum("value").alias("value"))


def reference_data(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Attributes given as (ticker, field, value) rows, one column per field; several values are joined."""
    return rows.groupBy("ticker").pivot("field", list(fields)).agg(F.concat_ws(" ", F.array_sort(F.collect_list("value"))))


def membership_panel(members: DataFrame, calendar: DataFrame) -> DataFrame:
    """1 or 0 for every date of the calendar and every ticker that is ever a member, from the first date with any member on."""
    own = members.select("obs_date", F.upper("ticker").alias("ticker")).distinct().join(calendar.select("obs_date").distinct(), "obs_date", "left_semi")
    grid = calendar.select("obs_date").distinct().crossJoin(own.select("ticker").distinct())
    on = grid.join(own.withColumn("__in", F.lit(1.0)), ["obs_date", "ticker"], "left").withColumn("value", F.coalesce("__in", F.lit(0.0))).drop("__in")
    some = own.groupBy("obs_date").agg(F.count("*").alias("n"))
    first = some.agg(F.min("obs_date").alias("__first"))
    return on.join(F.broadcast(first), F.col("obs_date") >= F.col("__first")).drop("__first")


def instruments_from_info(info: DataFrame, mapping: dict[str, str], values: dict[str, str] | None = None, default: str = "NA") -> DataFrame:
    """Instrument rows from a vendor's (ticker, info MAP) rows: keys renamed, values translated, missing ones set to the default."""
    cols = [F.upper("ticker").alias("ticker")]
    for key, name in mapping.items():
        v = F.coalesce(F.get(F.array(F.col("info")[key]), F.lit(0)), F.lit(default))
        for old, new in (values or {}).items():
            v = F.when(v == old, F.lit(new)).otherwise(v)
        cols.append(text.attribute(v).alias(name))
    return info.select(*cols)


def write_report(report: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """One table per sheet of a report, or one workbook if the folder's name ends in .xlsx; names of at most 31 characters."""
    if folder.endswith(".xlsx"):
        return xlsx.write_workbook(report, folder)
    for name, df in report.items():
        df.write.mode("overwrite").format(format).option("header", True).save(f"{folder}/{text.sheet_name(name)}.{format}")


def place(full_path: str | None = None, workbook: str | None = None, folder: str | None = None) -> str:
    """Where a report lies: a full path, or a workbook's name in a folder."""
    if (full_path is None) == (workbook is None and folder is None) or (workbook is None) != (folder is None):
        raise ValueError("give a full path, or a workbook and a folder")
    return full_path if full_path is not None else f"{folder.rstrip('/')}/{workbook}{'' if workbook.endswith('.xlsx') else '.xlsx'}"


def save_frames(frames: Sequence[DataFrame], sheets: Sequence[str], full_path: str | None = None, workbook: str | None = None, folder: str | None = None) -> str:
    """Writes each frame to the sheet of its place; returns where."""
    if len(frames) != len(sheets):
        raise ValueError("there are as many sheets as frames")
    where = place(full_path, workbook, folder)
    write_report(dict(zip(sheets, frames, strict=True)), where)
    return where


def read_sheet(spark: SparkSession, folder: str, name: str, format: str = "parquet") -> DataFrame:
    if folder.endswith(".xlsx"):
        return xlsx.read_sheet(materialized(xlsx.read_cells(spark, folder).where(F.col("sheet") == name[:31]), "cells"), name)
    return spark.read.format(format).option("header", True).load(f"{folder}/{text.sheet_name(name)}.{format}")


def list_tables(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Names in a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(n for f in found if (n := f.getPath().getName()).endswith(suffix))
