"""What a strategy opens of a store, and that it equals what it gives on the whole panel."""

import datetime as dt

import pytest

from panelith.plans import demand, strategy
from panelith.sources.store import PanelStore
from pyspark.sql import functions as F

D = dt.date


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Thirty years of weekdays; CC is published on Mondays only, DD from 2012 on."""
    s = PanelStore(spark, str(tmp_path_factory.mktemp("thirty") / "store"))
    names = ["AA", "BB", "CC", "DD"]
    s.add(spark.createDataFrame([(t, "STOCK", "EXCEL", "USD") for t in names], "ticker string, instrument_type string, data_source string, currency string"))
    days = spark.range(365 * 30).select(F.date_add(F.lit(D(1990, 1, 1)), F.col("id").cast("int")).alias("obs_date"), "id").where("weekday(obs_date) < 5")
    rows = days.crossJoin(spark.createDataFrame([(t, k) for k, t in enumerate(names)], "ticker string, k int"))
    rows = rows.where("(ticker <> 'CC' or weekday(obs_date) = 0) and (ticker <> 'DD' or obs_date >= '2012-01-01')")
    s.upsert(rows.select("obs_date", "ticker", F.lit("close").alias("field"), (100 + 10 * F.sin(F.col("id") / (11 + F.col("k"))) + F.col("id") % (7 + F.col("k"))).alias("value")))
    return s


NAMES = ["AA", "BB", "CC", "DD"]


def years(df):
    return {int(f.split("/year=")[1].split("/")[0]) for f in df.inputFiles() if "/year=" in f}


def calendar(spark, year):
    return spark.sql(f"select explode(sequence(date '{year}-01-31', date '{year}-12-31', interval 1 month)) as obs_date")


def test_years_from_the_rows_of_the_sparsest_ticker(store):
    assert store.since("close", ["AA"], D(2010, 6, 1), 20) == D(2009, 1, 1)
    assert store.since("close", ["AA"], D(2010, 6, 1), 400) == D(2008, 1, 1)
    assert store.since("close", ["AA", "CC"], D(2010, 6, 1), 100) == D(2008, 1, 1)  # 52 Mondays a year
    assert store.since("close", ["AA", "DD"], D(2012, 6, 1), 100) == D(2011, 1, 1)  # DD has none before its year
    assert store.since("close", ["DD"], D(2012, 6, 1), 100) == D(2012, 1, 1)
    assert store.since("close", ["AA"], D(2010, 6, 1), 0) == D(2010, 1, 1)


def make(spark, close, year=2010):
    u = strategy.Universe(NAMES, calendar(spark, year)).price_history(close, 30, 0.1)
    signals = [strategy.volatility_rank(u, close, [20, 60], number=2), strategy.performance_rank(u, close, 120, number=2), strategy.SmaCross(u, close, 10, 40)]
    return lambda k, **how: strategy.Strategy(signals[k], strategy.by_volatility(close, 30), close, **how)


@pytest.mark.parametrize("k", [0, 1, 2])
def test_a_year_of_thirty_opens_few_years(store, spark, k):
    pruned = make(spark, demand.StoredPanel(store, NAMES))(k).back_test(end="2010-12-31")
    assert years(pruned) <= {2007, 2008, 2009, 2010} and 2010 in years(pruned)
    whole = make(spark, store.close(NAMES))(k).back_test(end="2010-12-31")
    a, b = ([(r["obs_date"], r["value"]) for r in x.orderBy("obs_date").collect()] for x in (pruned, whole))
    assert [d for d, _ in a] == [d for d, _ in b] and [v for _, v in a] == pytest.approx([v for _, v in b]) and len(a) > 200


def test_overlays_and_optimised_weights_are_pruned_too(store, spark):
    close, market = demand.StoredPanel(store, NAMES), demand.StoredPanel(store, ["AA"])
    for prices, bench in ((close, market), (store.close(NAMES), store.close(["AA"]))):
        u = strategy.Universe(["AA", "BB"], calendar(spark, 2010)).price_history(prices, 30, 0.1)
        s = strategy.Strategy(u.eligibility(), strategy.by_optimizer(prices, 40), prices, strategy.BetaHedge(bench, lags=40))
        out = s.back_test(end="2010-12-31")
        weights = s.weights()
        if prices is close:
            assert years(weights) <= {2008, 2009, 2010}
            want = None
        got = [(r["obs_date"], r["value"]) for r in out.orderBy("obs_date").collect()]
        assert want is None or ([d for d, _ in got] == [d for d, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want]))
        want = got
    assert len(want) > 150


def test_what_counts_from_the_begin_needs_all(store, spark):
    panel = demand.StoredPanel(store, ["AA"])
    assert panel.since(D(2010, 1, 1), None) is None and panel.since(D(2010, 1, 1), 5, 3) is None
    assert panel.since(D(2010, 6, 1), 20, "wednesday") == D(2009, 1, 1)
    u = strategy.Universe(["AA"], calendar(spark, 2010)).published(panel, 5)
    assert min(years(u.eligibility())) == 1990


def test_hedges_refuse_benchmarks_that_are_too_short(store, spark):
    u = strategy.Universe(["AA", "BB"], calendar(spark, 2010))
    prices = store.close(["AA", "BB"], start="2009-01-01", end="2010-12-31")
    short = store.close(["AA"], start="2009-01-01", end="2010-06-30")
    s = strategy.Strategy(u.eligibility(), strategy.equal_weight, prices, strategy.BetaHedge(short, lags=20))
    with pytest.raises(Exception, match="span"):
        s.back_test().collect()
