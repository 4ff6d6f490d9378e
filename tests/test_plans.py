import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelith.functions import optimize
from panelith.plans import futures, report, strategy

SAMPLE = np.random.default_rng(20).normal(size=(200, 3)) @ np.array([[0.11, 0.02, 0.01], [0.0, 0.09, 0.03], [0.0, 0.0, 0.14]])
COV, MEANS = np.cov(SAMPLE.T), np.array([0.05, 0.01, 0.03])


def lagrange(cov, rows, right):
    """Least variance under equations, by the inverse of the covariance."""
    a, c = np.array(rows), np.linalg.inv(cov)
    return c @ a.T @ np.linalg.solve(a @ c @ a.T, right)


def test_optimizers():
    assert optimize.analytic(COV) == pytest.approx(lagrange(COV, [np.ones(3)], [1.0]))
    assert optimize.analytic(COV, MEANS) == pytest.approx(lagrange(COV, [np.ones(3), MEANS], [1.0, 0.05]))
    assert (optimize.analytic(COV) > 0).all()
    assert optimize.minimum_variance(COV) == pytest.approx(optimize.analytic(COV), abs=1e-6)
    w = optimize.minimum_variance(COV, low=0.25, high=0.4)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0.25, 0.4, 61) for b in np.linspace(0.25, 0.4, 61) if 0.25 <= 1 - a - b <= 0.4]
    assert w @ COV @ w <= min(np.array(g) @ COV @ np.array(g) for g in grid) + 1e-9
    w = optimize.mean_variance(MEANS, COV, min_total=1, max_total=1, return_target=0.03, factor=1)
    assert w.sum() == pytest.approx(1) and w @ MEANS >= 0.03 - 1e-9 and (w > -1e-9).all()
    frontier = optimize.efficient_frontier(MEANS, COV)
    assert len(frontier) == 50 and frontier[0][1] == pytest.approx(optimize.analytic(COV))
    with pytest.raises(ValueError):
        optimize.efficient_frontier([1, 1], COV[:2, :2])
    with pytest.raises(ValueError):
        optimize.instrument_bounds([0.1], 1.0, 2)


def both(spark, ret, weight, start=dt.date(2024, 1, 1)):
    rows = []
    for t in ret:
        rows += [(start + dt.timedelta(days=k), t, r, w) for k, (r, w) in enumerate(zip(ret[t], weight[t], strict=True))]
    return spark.createDataFrame(rows, "obs_date date, ticker string, ret double, weight double")


def test_rebalanced_index(spark):
    ret = {"A": [None, 0.1, 0.0, -0.05], "B": [None, 0.02, 0.04, None]}
    w = {"A": [0.5, 0.5, 1.0, 1.0], "B": [0.5, 0.5, 0.0, 0.0]}
    got = [r["value"] for r in strategy.index_rebalanced(both(spark, ret, w), 1).orderBy("obs_date").collect()]
    assert got == pytest.approx([100, 106, 106 * 1.02, 106 * 1.02 * 0.95])
    net = [r["value"] for r in strategy.index_rebalanced(both(spark, ret, w), 1, 0.01, 0.0365).orderBy("obs_date").collect()]
    steps = [0.06 - 0.0001, 0.02 - 0.01 * 1.0 - 0.0001, -0.05 - 0.0001]
    assert net == pytest.approx([100, *(100 * np.cumprod([1 + s for s in steps]))])
    for bad in ({"weight_lag": 0}, {"transaction_cost": -1}, {"initial": 0}):
        with pytest.raises(ValueError):
            strategy.index_rebalanced(both(spark, ret, w), **bad)


def test_drifting_index_against_a_loop(spark, make_panel):
    rng = np.random.default_rng(4)
    p = {t: (100 * np.cumprod(1 + 0.02 * rng.standard_normal(30))).tolist() for t in "AB"}
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    weights = {0: (0.5, 0.5), 9: (0.2, 0.8), 20: (0.9, 0.1)}
    wdf = spark.createDataFrame([(days[k], t, float(x)) for k, ws in weights.items() for t, x in zip("AB", ws, strict=True)], "obs_date date, ticker string, value double")
    got = [r["value"] for r in strategy.index_drifting(make_panel(p), wdf, 0.001, 0.02).orderBy("obs_date").collect()]
    level, base, last, w, want = 100.0, 0, 0, np.array(weights[0]), [100.0]
    for k in range(1, 30):
        gross = sum(w[i] * (p[t][k] / p[t][base] - 1) for i, t in enumerate("AB"))
        new = np.array(weights.get(k, w))
        f = 1 + gross - 0.02 * (k - last) / 360 - 0.001 * np.abs(new - w).sum()
        want.append(level * f)
        if k in weights:
            level, base, last = level * f, k, k
        w = new
    assert got == pytest.approx(want)


def test_universe_and_weights(spark, make_panel, columns):
    close = make_panel({"A": [1, None, 3, 4], "B": [None, None, None, 5]})
    cal = close.select("obs_date").distinct()
    u = strategy.Universe(["a", "b"], cal).price_history(close, 2, 0.5)
    assert columns(u.eligibility()) == {"A": [1, 1, 1, 1], "B": [None, None, None, 1]}
    assert columns(strategy.published_filter(close, 2)) == {"A": [0, 0, 0, 1], "B": [0, 0, 0, 0]}
    with pytest.raises(ValueError):
        strategy.Universe(["A"], cal).custom(close)
    s = make_panel({"A": [1], "B": [-1], "C": [None], "D": [1]})
    assert [v[0] for v in columns(strategy.equal_weight(s)).values()] == pytest.approx([1 / 3, -1 / 3, 0, 1 / 3])
    assert columns(strategy.equal_weight(s, net_zero=True)) == {"A": [0.5], "B": [-1], "C": [0], "D": [0.5]}
    m = make_panel({"A": [2], "B": [4], "C": [8], "D": [0]})
    assert [v[0] for v in columns(strategy.proportional_weight(s, m, inverse=True)).values()] == pytest.approx([2 / 3, -1 / 3, 0, 0])
    with pytest.raises(ValueError):
        strategy.Strategy(s, strategy.equal_weight, close, weight_lag=0)
    with pytest.raises(TypeError):
        strategy.Strategy("signal", strategy.equal_weight, close)


def test_optimized_weights(spark, make_panel):
    rng = np.random.default_rng(6)
    p = {t: (100 * np.cumprod(1 + s * rng.standard_normal(50))).tolist() for t, s in zip("ABC", (0.01, 0.02, 0.03), strict=True)}
    panel = make_panel(p)
    sig = panel.where("obs_date = '2024-02-10'").selectExpr("obs_date", "ticker", "if(ticker = 'B', null, 1.0D) as value")
    got = {r["ticker"]: r["value"] for r in strategy.optimized_weight(sig, panel, 20).collect()}
    r = pd.DataFrame(p).pct_change().fillna(0).iloc[21:41][["A", "C"]]
    assert [got["A"], got["C"]] == pytest.approx(optimize.analytic(np.cov(r.T)))
    assert got["B"] == 0


def test_report(make_panel):
    p = make_panel({"A": [100 + k for k in range(70)]})
    m = {(r["year"], r["month"]): r["value"] for r in report.monthly_returns(p).collect()}
    assert m[2024, 1] == pytest.approx(130 / 100 - 1) and m[2024, 2] == pytest.approx(159 / 130 - 1)
    t = report.monthly_table(p).collect()[0]
    assert t["yearly_return"] == pytest.approx(169 / 100 - 1) and t["Dec"] is None
    r = report.risk_and_return(p, window=20, own_tables=["A"])
    assert set(r) >= {"Performance", "Risk and return", "Return table (A)"} and r["Return table (A)"].count() == 1
    assert r["Risk and return"].collect()[0]["maximum_drawdown"] == 0
    with pytest.raises(ValueError):
        report.risk_and_return(p, benchmark="A")


def test_report_has_return_tables_of_all_tickers(make_panel):
    p = make_panel({t: [100 + k for k in range(40)] for t in "ABC"})
    r = report.risk_and_return(p, window=20)
    assert "Return table (B)" not in r
    assert sorted((x["ticker"], round(x["Jan"], 9)) for x in r["Return tables"].collect()) == [(t, 0.3) for t in "ABC"]


def slow_futures(prices, expiries, positions, roll, buffer):
    """Segment by segment, in pandas."""
    order = sorted(expiries, key=lambda t: (expiries[t], t))
    days, start, whole, done = list(prices.index), 0, [], False
    for n, t in enumerate(order):
        e = expiries[t]
        if e < days[-1]:
            end = max(k for k, d in enumerate(days) if d <= e) - buffer
        else:
            end, done = len(days) - 1, True
        seg = {}
        for pos, alloc in positions.items():
            held = order[n + pos - 1 : n + pos + 1]
            sub = prices.iloc[start : end + 1]
            w = pd.Series(1.0, index=sub.index)
            if done:
                shift = pd.Timestamp(e) - pd.offsets.BDay(roll + buffer - 1)
                w[[d for d in sub.index if pd.Timestamp(d) >= shift]] = 0
            else:
                w.iloc[-roll:] = 0
            w = (w.rolling(roll).mean().bfill()) * alloc
            for after in (0, 1):
                x = sub[held[after]] if after < len(held) else pd.Series(np.nan, index=sub.index)
                seg[pos, after, "r"] = x.ffill().pct_change(fill_method=None)
                seg[pos, after, "w"] = alloc - w if after else w
        f = pd.DataFrame(seg)
        whole.append(f if not whole else f.dropna())
        start = end
        if done:
            break
    f = pd.concat(whole)
    total = sum((f[p, a, "r"] * f[p, a, "w"].shift()).fillna(0) for p in positions for a in (0, 1))
    return total


def test_rolling_futures_against_segments(spark, make_panel):
    rng = np.random.default_rng(8)
    days = [d.date() for d in pd.bdate_range("2024-01-01", "2024-07-31")]
    names = ["F1", "F2", "F3", "F4", "F5", "F6"]
    cols = {t: 100 * np.cumprod(1 + 0.01 * rng.standard_normal(len(days))) for t in names}
    exp = dict(zip(names, [dt.date(2024, 2, 16), dt.date(2024, 3, 15), dt.date(2024, 5, 17), dt.date(2024, 6, 21), dt.date(2024, 8, 2), dt.date(2024, 9, 20)], strict=True))
    wide = pd.DataFrame(cols, index=days)
    rows = [(d, t, float(wide[t][d])) for t in names for d in days]
    p = spark.createDataFrame(rows, "obs_date date, ticker string, value double")
    e = spark.createDataFrame(list(exp.items()), "ticker string, expiry date")
    for positions in ({1: 1.0}, {1: 0.5, 2: 0.5}):
        got = {r["obs_date"]: r["index_return"] for r in futures.rolling_index(p, e, positions, 5, 1).collect()}
        want = slow_futures(wide, exp, positions, 5, 1)
        assert set(got) == set(want.index)
        assert max(abs(got[d] - want[d]) for d in want.index) < 1e-12
    with pytest.raises(ValueError):
        futures.rolling_index(p, e, roll_days=0)
