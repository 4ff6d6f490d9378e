import datetime as dt

import pytest

from panelith.sources.store import PanelStore
from panelith.sources.vendors import VendorSource

D = dt.date(2024, 1, 2)
MAPPING = {"quoteType": "instrument_type", "sector": "sector", "country": "country"}


def recorded(log, broken):
    """A connection that notes what it is asked for in a file and fails once: tasks run in other processes."""

    def quotes(tickers, start, end):
        with open(log, "a") as f:
            f.write(" ".join(tickers) + "\n")
        if broken.exists():
            raise RuntimeError("no session")
        days = [D + dt.timedelta(days=k) for k in range(3)]
        days = [d for d in days if start is None or d >= start]
        rows = [(d, t, f, v) for d in days for t in tickers for f, v in (("Close", 5.0), ("Volume", float("nan")), ("Dividend", 0.0))]
        return rows + [(D, t, "Dividend", 0.5) for t in tickers if t == "BB"] + [(D, t, "Split", 2.0) for t in tickers if t == "BB"]

    return quotes


def info(tickers):
    return [(t, {"quoteType": "etf", "sector": "high tech"}) for t in tickers]


@pytest.mark.parametrize("in_driver", [True, False])
def test_batches_reconnection_and_names(spark, tmp_path, in_driver):
    log, broken = tmp_path / "asked", tmp_path / "broken"
    broken.touch()
    source = VendorSource(recorded(log, broken), info, MAPPING, "YAHOO", reconnect=lambda: broken.unlink(missing_ok=True), batch=2, in_driver=in_driver)
    got = sorted((r["ticker"], r["obs_date"], r["field"], r["value"]) for r in source.facts(spark, ["aa", "bb", "SEK_USD.FX"]).collect())
    days = [D + dt.timedelta(days=k) for k in range(3)]
    assert got == sorted([(t, d, "close", 5.0) for t in ("AA", "BB", "SEK_USD.FX") for d in days] + [("BB", D, "dividend", 0.5), ("BB", D, "split", 2.0)])
    asked = set(log.read_text().splitlines())
    assert asked == {"AA BB", "SEK=X"}
    r = {x["ticker"]: x for x in source.instruments(spark, ["aa"]).collect()}["AA"]
    assert (r["instrument_type"], r["sector"], r["country"], r["data_source"]) == ("ETF", "HIGH_TECH", "NA", "YAHOO")
    broken.touch()
    source.reconnect = None
    with pytest.raises(Exception, match="no session"):
        source.facts(spark, ["aa"]).collect()


def test_store_is_fed_by_a_vendor(spark, tmp_path):
    """Ingest, then a refresh that asks from the latest date on: dividends and splits of one path."""
    source = VendorSource(recorded(tmp_path / "asked", tmp_path / "none"), info, MAPPING, "YAHOO", values={"etf": "stock"})
    store = PanelStore(spark, f"{tmp_path}/store")
    store.ingest(source, ["AA", "BB"], today=D)
    assert store.close(["AA", "BB"]).count() == 6 and store.dividends(["BB"]).count() == 1 and store.facts("split").count() == 1
    store.refresh(source, ["AA"], today=D)
    assert store.facts("close").count() == 6 and store.tickers({"instrument_type": "stock"}) == ["AA", "BB"]
