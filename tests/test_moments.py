"""Blocked Gram matrices and sliding covariances against pandas and numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelith.functions import optimize
from panelith.operators import cross, gram
from panelith.plans import sliding, strategy
from pyspark.sql import functions as F


def series(seed, n, names, missing=0.2):
    rng = np.random.default_rng(seed)
    x = 1000 + rng.normal(size=(n, len(names))).cumsum(axis=0)
    return pd.DataFrame(np.where(rng.random(x.shape) < missing, np.nan, x), index=[dt.date(2023, 12, 1) + dt.timedelta(days=k) for k in range(n)], columns=names)


@pytest.fixture
def held(spark):
    x = series(1, 90, [f"T{k}" for k in range(11)])
    x["FLAT"], x.loc[x.index[5:], "RARE"] = 7.0, np.nan
    x.loc[x.index[:1], "RARE"] = 3.0
    rows = [(d, t, None if np.isnan(v) else float(v)) for d, r in x.iterrows() for t, v in r.items()]
    return x, spark.createDataFrame(rows, "obs_date date, ticker string, value double")


def test_correlations_over_tiles_and_blocks(held):
    x, panel = held
    for size in ((512, 128), (7, 3)):
        m = gram.moments(panel.where("value is not null"), [], *size).where("n > 0").withColumn("r", gram.correlation()).collect()
        got = {(r["ticker_1"], r["ticker_2"]): (r["n"], r["r"]) for r in m}
        want = x.corr(min_periods=2)
        both = x.notna().astype(int).T @ x.notna().astype(int)
        assert len(got) == len(m) == int((both.to_numpy() > 0).sum())
        for (a, b), (n, r) in got.items():
            assert n == both.loc[a, b]
            if np.isnan(want.loc[a, b]) or n < 2:
                assert r is None or n < 2 or "FLAT" in (a, b)
            else:
                assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_covariances_per_key_and_missing_values(held):
    x, panel = held
    keyed = panel.withColumn("half", (F.month("obs_date") == 12).cast("int"))
    got = {(r["half"], r["ticker_1"], r["ticker_2"]): r["value"] for r in cross.covariance(keyed, ["half"]).collect()}
    assert len(got) == 2 * 13 * 13
    for half, part in x.groupby(lambda d: int(d.month == 12)):
        for a in x.columns:
            for b in x.columns:
                both = part[[a, b]].T.drop_duplicates().T if a == b else part[[a, b]]
                whole = not part[a].isna().any() and not part[b].isna().any()
                want = np.cov(part[a], part[b])[0, 1] if whole else None
                assert got[half, a, b] == (None if want is None else pytest.approx(want, abs=1e-9)), (half, a, b, both.shape)


def test_large_levels_keep_their_digits(spark):
    x = series(2, 40, ["A", "B"], 0.0) + 1e8
    rows = [(d, t, float(v)) for d, r in x.iterrows() for t, v in r.items()]
    got = {(r["ticker_1"], r["ticker_2"]): r["value"] for r in cross.covariance(spark.createDataFrame(rows, "obs_date date, ticker string, value double")).collect()}
    assert got["A", "B"] == pytest.approx(x.cov().loc["A", "B"], rel=1e-6) and got["A", "A"] == pytest.approx(x["A"].var(), rel=1e-6)


@pytest.mark.parametrize("window", [2, 5, 40, 1000])
def test_sliding_moments(window):
    x = series(3, 900, list("ABCD"), 0.0).pct_change().fillna(0.0).to_numpy()
    x[400, 1] = np.nan
    m = sliding.Moments(x, window)
    for end in [0, 1, 2, *range(3, 900, 7), 899]:
        for cols in (np.array([0, 2, 3]), np.arange(4)):
            rows = x[max(0, end + 1 - window) : end + 1][:, cols]
            got = m.covariance(end, cols)
            if len(rows) < 2 or np.isnan(rows).any():
                assert np.isnan(got).all()
            else:
                assert got == pytest.approx(np.cov(rows.T), abs=1e-12)


def test_weights_equal_those_of_each_slice_alone(spark):
    x = series(4, 400, list("ABCDE"), 0.03)
    rows = [(d, t, None if np.isnan(v) else float(v)) for d, r in x.iterrows() for t, v in r.items()]
    prices = spark.createDataFrame(rows, "obs_date date, ticker string, value double").cache()
    days = [d for k, d in enumerate(x.index) if k % 9 == 4]
    eligible = {(d, t): (k + ord(t)) % 4 > 0 for k, d in enumerate(days) for t in "ABCDE"}
    signal = spark.createDataFrame([(d, t, 1.0 if ok else None) for (d, t), ok in eligible.items()], "obs_date date, ticker string, value double")
    got = {(r["obs_date"], r["ticker"]): r["value"] for r in strategy.optimized_weight(signal, prices, 30, low=0.0, high=0.6).collect()}
    returns = x.ffill().pct_change(fill_method=None).fillna(0.0)
    assert len(got) == len(eligible)
    for d in days:
        own = [t for t in "ABCDE" if eligible[d, t]]
        r = returns.loc[:d, own].tail(30)
        want = optimize.minimum_variance(np.cov(r.to_numpy().T), low=0.0, high=0.6) if len(r) > 1 else [0.0] * len(own)
        assert [got[d, t] for t in own] == pytest.approx(list(want), abs=1e-6)
        assert all(got[d, t] == 0 for t in "ABCDE" if t not in own)


def test_a_row_goes_to_two_tasks_at_most(spark):
    dates = spark.range(500).select(F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("obs_date"))
    panel = dates.withColumn("ticker", F.lit("A")).withColumn("value", F.rand(1))
    numbered = sliding.numbered(panel)
    ends = numbered.select(F.col("obs_date").alias("slice_date"), F.col("no").alias("end"))
    size = sliding.solved(panel, numbered, ends, None, 100, lambda x, cov, start: np.full(len(cov), len(x)))
    got = {r["weight"] for r in size.where("obs_date > '2020-04-20'").collect()}
    assert got == {100.0}
