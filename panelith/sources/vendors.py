"""Vendor connections as sources: anything that answers a batch of tickers with rows.

A connection gives two functions that return rows; batching, one reconnection after a failure, ticker forms and tidying are done here.
Every batch of tickers is asked for in a task of its own, so the functions must be serialisable and the rows never meet in one place;
a task that is run again asks again. A session that can't leave the driver is asked there (``in_driver``), batch by batch.
No vendor library is part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.frames import no_nan
from .readers import instruments_from_info

#: Tickers asked for at once.
BATCH = 100

Rows = Iterable[tuple]


QUOTES = "obs_date date, vendor string, field string, value double"
INFO = "vendor string, info map<string,string>"


class VendorSource:
    """``quotes(tickers, start, end)`` gives (date, ticker, field, value), ``info(tickers)`` gives (ticker, {key: value}).

    ``to_vendor`` renders a ticker column the vendor's way; results come back under the own tickers.
    """

    def __init__(
        self,
        quotes: Callable[..., Rows],
        info: Callable[[list[str]], Rows],
        mapping: dict[str, str],
        data_source: str,
        to_vendor: Callable = text.fx_to_quote,
        reconnect: Callable[[], None] | None = None,
        batch: int = BATCH,
        in_driver: bool = False,
        values: dict[str, str] | None = None,
    ):
        self.quotes, self.info, self.mapping, self.data_source, self.to_vendor = quotes, info, mapping, data_source, to_vendor
        self.reconnect, self.batch, self.in_driver, self.values = reconnect, batch, in_driver, values

    def _ask(self, names: DataFrame, fn: Callable[..., Rows], schema: str, *more) -> DataFrame:
        """The rows of all batches of ``names`` (vendor)."""
        reconnect, spark = self.reconnect, names.sparkSession
        at = F.floor((F.row_number().over(Window.orderBy("vendor")) - 1) / self.batch)  # over one row per ticker
        batches = names.select("vendor").distinct().withColumn("batch", at).groupBy("batch").agg(F.array_sort(F.collect_list("vendor")).alias("tickers"))

        def rows(tickers: list[str]) -> list[tuple]:
            try:
                return list(fn(tickers, *more))
            except RuntimeError:
                if reconnect is None:
                    raise
                reconnect()
                return list(fn(tickers, *more))

        if self.in_driver:
            parts = [spark.createDataFrame(rows(list(r["tickers"])), schema) for r in batches.orderBy("batch").collect()]
            return reduce(DataFrame.unionAll, parts, spark.createDataFrame([], schema))
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for tickers in frame["tickers"]:
                    yield pd.DataFrame(rows(list(tickers)), columns=columns)

        n = -(-names.count() // self.batch)
        return batches.repartition(max(1, n), "batch").select("tickers").mapInPandas(run, schema)

    def _names(self, spark: SparkSession, tickers: Sequence[str] | DataFrame) -> DataFrame:
        if isinstance(tickers, DataFrame):
            own = tickers.select(F.upper("ticker").alias("ticker")).distinct()
        else:
            own = spark.createDataFrame([(t.upper(),) for t in dict.fromkeys(tickers)], "ticker string")
        return own.withColumn("vendor", self.to_vendor(F.col("ticker")))

    def facts(self, spark: SparkSession, tickers: Sequence[str], start=None, end=None) -> DataFrame:
        names = self._names(spark, tickers)
        got = self._ask(names, self.quotes, QUOTES, start, end)
        value = F.when(F.lower("field").isin("dividend", "split"), F.nullif(no_nan("value"), F.lit(0.0))).otherwise(no_nan("value"))
        return got.join(names, "vendor").select("obs_date", "ticker", F.lower("field").alias("field"), value.alias("value")).where("value is not null")

    def instruments(self, spark: SparkSession, tickers: Sequence[str]) -> DataFrame:
        names = self._names(spark, tickers)
        got = self._ask(names, self.info, INFO).join(names, "vendor")
        return instruments_from_info(got.select("ticker", "info"), self.mapping, self.values).withColumn("data_source", F.lit(self.data_source))
