"""Membership stretches, futures chains, corner portfolios and getters of lists, each against a plain loop."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from panelith.functions import optimize
from panelith.plans import futures, strategy
from panelith.sources import membership
from panelith.sources.store import DataGetter, PanelStore
from pyspark.sql import functions as F

D = dt.date


def days(spark, n, every=1, start=D(2020, 1, 1)):
    return spark.createDataFrame([(start + dt.timedelta(days=k),) for k in range(0, n, every)], "obs_date date")


def test_stretches_and_back(spark):
    rng = random.Random(1)
    calendar = [r[0] for r in days(spark, 60, 2).collect()]
    members = {(d, t) for d in calendar for t in "abc" if rng.random() < 0.6} | {(calendar[3], "solo")}
    rows = spark.createDataFrame([*members, *list(members)[:5], (D(2020, 1, 2), "a")], "obs_date date, ticker string")  # repeated, and off the calendar
    runs = membership.stretches(rows, days(spark, 60, 2))
    want = set()
    for t in {t for _, t in members}:
        inside = [(d, t) in members for d in calendar]
        for on, group in itertools.groupby(range(len(calendar)), key=lambda k: inside[k]):
            group = list(group)
            if on:
                want.add((t.upper(), calendar[group[0]], calendar[group[-1]]))
    assert {tuple(r) for r in runs.collect()} == want
    assert {tuple(r) for r in membership.daily(runs, days(spark, 60, 2)).collect()} == {(d, t.upper()) for d, t in members}
    # on another calendar, with dates before, between and behind
    other = days(spark, 90, 1, D(2019, 12, 20))
    got = {tuple(r) for r in membership.daily(runs, other).collect()}
    assert got == {(r[0], t) for r in other.collect() for t, a, b in want if a <= r[0] <= b}
    assert membership.daily(runs.where("ticker = 'none'"), other).count() == 0


def test_export_and_load(spark, tmp_path):
    runs = spark.createDataFrame([("AA", D(2020, 1, 10), D(2020, 3, 5)), ("BB", D(2020, 2, 1), D(2020, 2, 20))], "ticker string, start date, end date")
    calendar = days(spark, 120)
    for folder in (str(tmp_path / "sheets"), str(tmp_path / "book.xlsx")):
        membership.export(runs, calendar, folder, "M")
        got = {(r["obs_date"], r["ticker"]): r["value"] for r in membership.load_eligibility(spark, folder).collect()}
        assert got == {(D(2020, 1, 31), "AA"): 1, (D(2020, 2, 29), "AA"): 1, (D(2020, 3, 31), "AA"): 0, (D(2020, 4, 29), "AA"): 0}
    panel = membership.load_eligibility(spark, folder)
    u = strategy.Universe(["AA"], panel.select("obs_date").distinct()).custom(panel)
    assert u.eligibility().where("value = 1").count() == 2
    with pytest.raises(ValueError):
        membership.at_frequency(calendar, "2H")


def test_chains_against_a_loop(spark):
    rng = random.Random(2)
    contracts = [(g, f"C{k}{g}", D(2020, 1, 1) + dt.timedelta(days=rng.randrange(60)), D(2020, 1, 1) + dt.timedelta(days=rng.randrange(20, 100, 5))) for k in range(12) for g in ("x", "y")]
    contracts += [("x", "LATE", D(2020, 3, 1), D(2020, 3, 1)), ("x", "NEVER", D(2020, 3, 2), D(2020, 3, 1))]
    held = spark.createDataFrame(contracts, "generic string, ticker string, listed date, expiry date")
    calendar = [D(2019, 12, 25) + dt.timedelta(days=k) for k in range(130)]
    want = set()
    for d, g in itertools.product(calendar, ("x", "y")):
        live = sorted((e, t.upper()) for gen, t, a, e in contracts if gen == g and a <= d <= e)
        want |= {(d, g.upper(), n + 1, t) for n, (_, t) in enumerate(live)}
    dates = spark.createDataFrame([(d,) for d in calendar], "obs_date date")
    assert {tuple(r) for r in futures.chain_on(held, dates).collect()} == want
    assert {tuple(r) for r in futures.chain_on(held, dates, 2).collect()} == {w for w in want if w[2] <= 2}
    spans = futures.chain(held, 1).collect()
    assert all(r["start"] <= r["end"] for r in spans)
    with pytest.raises(ValueError):
        futures.chain(held, 0)
    with pytest.raises(ValueError):
        futures.rolling_index(held, held, {0: 1.0})


def brute(means, cov, lo, hi, level):
    """The least of half the variance less level times return, over all ways of putting assets on their bounds."""
    n, best = len(means), None
    for at in itertools.product((0, 1, 2), repeat=n):
        free = [k for k in range(n) if at[k] == 2]
        w = np.where(np.array(at) == 1, hi, lo).astype(float)
        if free:
            f, b = np.array(free), np.array([k for k in range(n) if at[k] != 2], dtype=int)
            kkt = np.block([[cov[np.ix_(f, f)], -np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
            w[f] = np.linalg.solve(kkt, np.append(level * means[f] - cov[np.ix_(f, b)] @ w[b], 1 - w[b].sum()))[:-1]
        if abs(w.sum() - 1) < 1e-9 and (w >= lo - 1e-9).all() and (w <= hi + 1e-9).all():
            value = 0.5 * w @ cov @ w - level * w @ means
            best = (value, w) if best is None or value < best[0] - 1e-15 else best
    return best[1]


@pytest.mark.parametrize("seed", range(8))
def test_corners_of_four_assets(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 4)) * rng.uniform(0.5, 2, 4)
    cov, means = np.cov(x.T), rng.normal(size=4)
    lo, hi = (np.zeros(4), np.ones(4)) if seed % 2 else (np.full(4, 0.05), np.array([0.4, 0.5, 0.6, 0.3]))
    w = optimize.corner_portfolios(means, cov, lo, hi)
    assert w.sum(axis=1) == pytest.approx(np.ones(len(w))) and (w >= lo - 1e-9).all() and (w <= hi + 1e-9).all()
    assert w[-1] == pytest.approx(brute(means, cov, lo, hi, 0.0), abs=1e-7) and w[-1] == pytest.approx(optimize.minimum_variance(cov, low=list(lo), high=list(hi)), abs=1e-4)
    assert w[0] @ means == pytest.approx(brute(means, cov, lo, hi, 1e7) @ means, abs=1e-4)
    assert (np.diff(w @ means) < 1e-9).all()
    # every optimum lies on the line between two neighbouring corners
    for level in (0.01, 0.1, 0.5, 1.0, 3.0, 20.0):
        best = brute(means, cov, lo, hi, level)
        gaps = []
        for a, b in itertools.pairwise(w):
            t = np.clip((best - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
            gaps.append(np.abs(a + t * (b - a) - best).max())
        gaps.append(min(np.abs(c - best).max() for c in w))
        assert min(gaps) < 1e-6, (level, gaps)
    with pytest.raises(ValueError):
        optimize.corner_portfolios(means, cov, 0.5, 1.0)


def test_lists_per_date(spark, tmp_path):
    s = PanelStore(spark, str(tmp_path / "store"))
    s.add(spark.createDataFrame([(t, "STOCK", "EXCEL", "USD") for t in ("AA", "BB", "CC")], "ticker string, instrument_type string, data_source string, currency string"))
    rows = [(D(2020, 1, 1) + dt.timedelta(days=k), t, "close", 100.0 + (k * (ord(t[0]) - 60)) % 17) for k in range(900) for t in ("AA", "BB", "CC")]
    s.upsert(spark.createDataFrame(rows, "obs_date date, ticker string, field string, value double"))
    calendar = days(spark, 40, 10, D(2022, 5, 1))
    lists = spark.createDataFrame([(D(2022, 5, 1), "aa"), (D(2022, 5, 1), "BB"), (D(2022, 5, 15), "CC"), (D(2022, 5, 15), "AA")], "obs_date date, ticker string")
    got = {(r["obs_date"].day, r["ticker"]): r["value"] for r in DataGetter(s, lists, calendar, window=5).volatility().collect()}
    whole = {(r["obs_date"].day, r["ticker"]): r["value"] for r in DataGetter(s, ["AA", "BB", "CC"], calendar, window=5).volatility().collect()}
    assert set(got) == {(1, "AA"), (1, "BB"), (11, "AA"), (11, "BB"), (21, "AA"), (21, "CC"), (31, "AA"), (31, "CC")}
    assert all(v == pytest.approx(whole[k]) for k, v in got.items())
    opened = DataGetter(s, lists, calendar, window=5).volatility().inputFiles()
    assert {f.split("/year=")[1][:4] for f in opened if "/year=" in f} == {"2021", "2022"}
    with pytest.raises(ValueError):
        DataGetter(s, lists, calendar, window=5).beta("ZZ")


def test_universe_of_a_date_range(spark):
    u = strategy.Universe(["AA"], start="2020-01-01", periods=3, freq="M")
    assert [r[0] for r in u.calendar.orderBy("obs_date").collect()] == [D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31)]
    assert u.span() == (D(2020, 1, 31), D(2020, 3, 31))
    with pytest.raises(ValueError):
        strategy.Universe(["AA"])
    with pytest.raises(ValueError):
        strategy.Universe(["AA"], u.calendar, start="2020-01-01", periods=3)


def test_kept_panels(spark, tmp_path):
    s = PanelStore(spark, str(tmp_path / "store"))
    s.add(spark.createDataFrame([(t, "STOCK", "EXCEL", "USD") for t in ("AA", "BB")], "ticker string, instrument_type string, data_source string, currency string"))
    schema = "obs_date date, ticker string, field string, value double"
    s.upsert(spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=k), t, "close", 100.0 + k % 7) for k in range(400) for t in ("AA", "BB")], schema))

    def facts_read(df):
        return any("/facts/" in f for f in df.inputFiles())

    g = DataGetter(s, ["AA", "BB"], days(spark, 30, 10, D(2020, 11, 1)), window=20, keep=True)
    first = g.volatility().orderBy("obs_date", "ticker").collect()
    assert not facts_read(g.holding_period_return()) and g._kept[1:3] == ("2020-01-01", "2020-11-21")
    kept = g._kept
    g.calendar = days(spark, 20, 10, D(2020, 11, 1))
    assert g.volatility().count() == 4 and g._kept is kept  # less is asked for
    g.calendar = days(spark, 60, 10, D(2020, 11, 1))
    assert g.volatility().count() == 12 and g._kept is not kept  # more is asked for
    kept = g._kept
    s.upsert(spark.createDataFrame([(D(2020, 10, 30), "AA", "close", 500.0)], schema), replace="exact")
    again = g.volatility().orderBy("obs_date", "ticker").collect()
    assert g._kept is not kept and again[0]["value"] > first[0]["value"]
    g.keep = False
    assert facts_read(g.volatility())


def test_new_stores_and_reports_in_place(spark, tmp_path):
    from panelith.plans import report
    from panelith.sources import readers
    from panelith.sources.store import open_store

    s = open_store(str(tmp_path / "new"))
    assert s.log.numbers() == [1] and s.facts().count() == 0 and open_store(s.path).log.numbers() == [1]
    s.add(spark.createDataFrame([("AA", "STOCK", "EXCEL", "USD")], "ticker string, instrument_type string, data_source string, currency string"))
    assert {"last_close_refresh", "last_split_refresh"} <= set(s.instruments().columns)
    wide = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=k), 100.0 + k) for k in range(40)], "date date, AA double")
    where = readers.save_frames([wide], ["levels"], workbook="book", folder=str(tmp_path))
    assert where.endswith("/book.xlsx")
    tables = report.report_of_sheet(spark, where, "levels", str(tmp_path / "out"), window=10)
    assert tables["Performance"].agg(F.min("value")).first()[0] == 100 and readers.read_sheet(spark, str(tmp_path / "out"), "Risk and return").count() == 1
    for bad in ({}, {"full_path": "a", "workbook": "b", "folder": "c"}, {"workbook": "b"}):
        with pytest.raises(ValueError):
            readers.place(**bad)
    with pytest.raises(ValueError):
        readers.save_frames([wide], [], full_path="x")
    with pytest.raises(TypeError):
        from panelith.operators import cross

        cross.frequency_filter(wide, 1.5)


def test_contracts_are_updated_without_a_list_of_them_in_the_driver(spark, monkeypatch):
    from panelith import store_queries

    frame, most = type(spark.range(0)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: most.append(len(rows := collect(df))) or rows)
    out = store_queries.Q["futures_contracts_updated"][0](spark, "/root/testdata/sf0.001")
    rows = collect(out)
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() and {r["n"] for r in rows} == {3}
    assert max(most) < 50 < len(rows)
