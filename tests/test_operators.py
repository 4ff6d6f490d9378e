import numpy as np
import pandas as pd
import pytest

from panelith.operators import asof, clean, cross, rolling

N = None


def wide(cols):
    return pd.DataFrame({k: pd.Series(v, dtype=float) for k, v in cols.items()})


def same(got, want, tol=1e-9):
    for k in want:
        a = np.array([np.nan if x is None else x for x in got[k]], dtype=float)
        assert np.allclose(a, np.asarray(want[k], dtype=float), equal_nan=True, atol=tol), (k, a, want[k])


@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(2)
    out = {}
    for t in "ABC":
        v = (100 * np.cumprod(1 + 0.01 * rng.standard_normal(60))).tolist()
        out[t] = v
    out["A"][10] = None
    for k in range(20, 27):
        out["B"][k] = None
    for k in range(8):
        out["C"][k] = None
    return out


def published(df, fn):
    """Drops gaps per column, applies fn, puts the result back on the calendar, fills and masks stale stretches."""
    out = {}
    for c in df:
        s = df[c].dropna()
        r = fn(s).reindex(df.index).ffill()
        stale = df[c].isna().astype(int).rolling(6).sum() == 6
        out[c] = r.where(~stale)
    return pd.DataFrame(out)


def test_fills(make_panel, columns):
    p = make_panel({"A": [N, 1, N, 3], "B": [N, N, N, N]})
    assert columns(clean.ffill(p)) == {"A": [N, 1, 1, 3], "B": [N] * 4}
    assert columns(clean.bfill(p)) == {"A": [1, 1, 3, 3], "B": [N] * 4}
    assert columns(clean.drop_empty_dates(p)) == {"A": [1, 3], "B": [N, N]}
    assert clean.drop_incomplete_dates(p).count() == 0
    assert clean.null_policy(p, "skip").count() == 2
    with pytest.raises(ValueError):
        clean.null_policy(p, "other")


def test_changes(make_panel, columns, gappy):
    p, df = make_panel(gappy), wide(gappy)
    f = df.ffill()
    same(columns(rolling.pct_change_pad(p)), f / f.shift() - 1)
    same(columns(rolling.pct_change_raw(p)), df / df.shift() - 1)
    same(columns(rolling.holding_period_return(p, 5, 2)), f.shift(2) / f.shift(5) - 1)
    with pytest.raises(ValueError):
        rolling.holding_period_return(p, 5, -1)


def test_windows(make_panel, columns, gappy):
    p, df = make_panel(gappy), wide(gappy)
    same(columns(rolling.simple_moving_average(p, 5)), df.rolling(5).mean())
    same(columns(rolling.simple_moving_average(p)), df.expanding(1).mean())
    same(columns(rolling.volatility(prices=p, lags=10)), published(df, lambda s: s.pct_change(fill_method=None).rolling(10).std() * 252**0.5))
    two = published(df, lambda s: np.maximum(s.pct_change(fill_method=None).rolling(5).std(), s.pct_change(fill_method=None).rolling(10).std()) * 252**0.5)
    same(columns(rolling.volatility(prices=p, lags=[5, 10])), two.where(published(df, lambda s: s.pct_change(fill_method=None).rolling(10).std()).notna()))
    same(columns(rolling.rolling_average(p, 4)), published(df, lambda s: s.rolling(4).mean()))
    f = df.ffill()
    same(columns(rolling.rolling_drawdown(p, 10)), f / f.rolling(10, min_periods=1).max() - 1)
    b = f["A"].pct_change(fill_method=None)
    got = columns(rolling.realized_beta(clean.ffill(p), "a", 1, 10))
    r = f.pct_change(fill_method=None)
    pairs = r.apply(lambda c: c.rolling(10).cov(b) / b.where(c.notna()).rolling(10).var())
    same(got, pairs)
    with pytest.raises(ValueError):
        rolling.volatility(prices=p, returns=p)
    with pytest.raises(ValueError):
        rolling.volatility(prices=p, lags=1)
    with pytest.raises(ValueError):
        rolling.realized_beta(p, "NONE", 1, 5)


def test_constant_prices_have_no_beta_and_no_error(make_panel, columns):
    p = make_panel({"A": [100.0] * 12, "B": [100.0 + k for k in range(12)]})
    bench = p.where("ticker = 'A'").select("obs_date", "value")
    assert set(columns(rolling.beta(prices=p, benchmark=bench, lags=5))["B"]) == {None}


def test_returns_to_prices(make_panel, columns):
    assert columns(rolling.returns_to_prices(make_panel({"A": [N, 0.1, N, 0.5, N]})))["A"] == [1, N, 1, N, 1]
    got = columns(rolling.returns_to_prices(make_panel({"A": [N, 0.1, 0.2]})))["A"]
    assert got == pytest.approx([1.0, 1.1, 1.32])


def test_ranks_and_ties(make_panel, columns):
    p = make_panel({"A": [1, 5], "B": [1, N], "C": [0, 5], "D": [7, 1], "E": [2, 2]})
    assert columns(cross.rank_filter(p, True, True, 2)) == {"A": [1, N], "B": [N, N], "C": [1, N], "D": [N, 1], "E": [N, 1]}
    assert columns(cross.rank_filter(p, False, True, 1)) == {"A": [N, 1], "B": [N, N], "C": [N, N], "D": [1, N], "E": [N, N]}
    # a fraction of five rounds half to even: two
    assert sum(v[0] == 1 for v in columns(cross.rank_filter(p, True, True, 0.5)).values()) == 2
    assert sum(v[0] == 1 for v in columns(cross.rank_filter(p, True, False, 0.5)).values()) == 3
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            cross.rank_filter(p, True, True, bad)
    e = make_panel({k: [1, 1] for k in "ABCDE"})
    assert columns(cross.top_k(p, e, number=1, drop_best_number=1)) == {"A": [N, N], "B": [N, N], "C": [N, 1], "D": [N, N], "E": [1, N]}
    for how in ({}, {"number": 1, "fraction": 0.5}, {"number": 0}, {"fraction": 1.0}):
        with pytest.raises(ValueError):
            cross.top_k(p, e, **how)


def test_winsorize(make_panel, columns):
    p = make_panel({"A": [1], "B": [2], "C": [3], "D": [4]})
    assert columns(cross.winsorize(p, 0.1, 0.9)) == {"A": [N], "B": [2], "C": [3], "D": [N]}
    with pytest.raises(ValueError):
        cross.winsorize(p, 0.9, 0.1)


def test_aggregates_and_signals(make_panel, columns):
    a, b = make_panel({"A": [1, N, 3]}), make_panel({"A": [2, 2, -1]})
    assert columns(cross.aggregate([a, b], "max")) == {"A": [2, N, 3]}
    assert columns(cross.combine_signals([a, b], "union")) == {"A": [2, 2, 3]}
    assert columns(cross.combine_signals([a, b], "intersection")) == {"A": [2, N, -3]}
    with pytest.raises(ValueError):
        cross.aggregate([a, b], "sum")
    assert cross.same_shape(a, b) and not cross.same_shape(a, b.limit(2))
    assert cross.only_values(a, 1, 3) and not cross.only_values(b, 2)


def test_as_of(make_panel, columns, spark):
    p = make_panel({"A": [1, N, 3], "B": [4, 5, N]})
    import datetime as dt

    days = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 1, 2),), (dt.date(2024, 2, 1),)], "obs_date date")
    # the row as of a date is taken with its gaps
    assert columns(asof.on_calendar(p, days)) == {"A": [N, N, 3], "B": [N, 5, N]}
    slices = {(r["slice_date"].day, r["ticker"]): r["n"] for r in asof.trailing_slices(p, days, 2).groupBy("slice_date", "ticker").count().withColumnRenamed("count", "n").collect()}
    assert slices == {(2, "A"): 2, (2, "B"): 2, (1, "A"): 2, (1, "B"): 2}
    with pytest.raises(ValueError):
        asof.weights_on_prices(p, make_panel({"A": [1]}))


def test_frequency(make_panel, columns):
    p = make_panel({"A": list(range(10))})
    assert columns(cross.frequency_filter(p, 3)) == {"A": [0, 3, 6, 9]}
    assert columns(cross.frequency_filter(p, "Tuesday")) == {"A": [1, 8]}
    for bad in (0, "noday"):
        with pytest.raises(ValueError):
            cross.frequency_filter(p, bad)


def test_empty_and_small_panels(make_panel):
    empty = make_panel({})
    for fn in (clean.ffill, lambda p: rolling.volatility(prices=p), lambda p: cross.rank_filter(p, True, True, 1), lambda p: rolling.maximum_drawdown(p), lambda p: asof.on_calendar(p, p)):
        assert fn(empty).count() == 0
    for fn in (clean.ffill, lambda p: rolling.volatility(prices=p, lags=2), lambda p: cross.rank_filter(p, True, True, 1), lambda p: rolling.maximum_drawdown(p), lambda p: asof.on_calendar(p, p)):
        fn(make_panel({"A": [1, 2, 3]})).collect()


def test_too_few_rows_are_refused(spark, make_panel):
    from panelith.operators import rolling

    p = make_panel({"A": [1.0, 2.0, 3.0]})
    assert rolling.rolling_average(p, 3).count() == 3
    for metric in (lambda: rolling.rolling_average(p, 4), lambda: rolling.volatility(prices=p, lags=3)):
        with pytest.raises(Exception, match="rows are needed"):
            metric().collect()
