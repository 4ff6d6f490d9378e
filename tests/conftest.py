import datetime as dt

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "2g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_panel(spark):
    """A panel from {ticker: [values]}; row k is k days after the first of January 2024."""

    def make(columns, start=dt.date(2024, 1, 1)):
        rows = [(start + dt.timedelta(days=k), t, None if v is None else float(v)) for t, vs in columns.items() for k, v in enumerate(vs)]
        return spark.createDataFrame(rows, "obs_date date, ticker string, value double")

    return make


@pytest.fixture(scope="session")
def columns():
    """The panel as {ticker: [values in order of date]}."""

    def get(panel, value="value"):
        out = {}
        for r in panel.orderBy("ticker", "obs_date").collect():
            out.setdefault(r["ticker"], []).append(r[value])
        return out

    return get
