"""Registered queries of the panel store, its sources and helpers, each beside SQL over the driver's tables.

Every query writes a store of its own in the shared folder and reads through ``PanelStore`` and ``DataGetter``. Brands that end in 4 (or 9) are indices,
in 3 (or 8) ETFs, the others stocks; the opening price is the low.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar, text
from .operators import clean, cross, rolling
from .plans import futures, report, strategy
from .plans.demand import StoredPanel
from .queries import Q, RET, _TR, _index, _r, _sql, _stale, _vol, WT, dividends, fx, instruments, month_ends, panel, quotes, register, rounded
from .queries import _table as table
from .sources import membership, readers
from .sources.shared import exists, file_system, scratch, stamp
from .sources.store import DataGetter, PanelStore
from .sources.vendors import VendorSource

FACTS = "obs_date date, ticker string, field string, value double"
DAY = dt.date(1999, 6, 30)
KIND = "CASE CAST(right(ticker, 1) AS INT) % 5 WHEN 4 THEN 'INDEX' WHEN 3 THEN 'ETF' ELSE 'STOCK' END"
CURRENCY = "['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE_EAST'][CAST(right(ticker, 1) AS INT) % 5 + 1]"
STOCKS = "CAST(right(ticker, 1) AS INT) % 5 <> 4"
IDIV = f"idiv AS (SELECT * FROM div WHERE {STOCKS})"
#: All stored rows of the plain store, as the SQL sees them.
ALL = (
    IDIV,
    f"st AS (SELECT 'close' AS field, obs_date, ticker, close AS value FROM px UNION ALL SELECT 'open', obs_date, ticker, low FROM px UNION ALL SELECT 'low', obs_date, ticker, low FROM px "
    f"UNION ALL SELECT 'high', obs_date, ticker, high FROM px UNION ALL SELECT 'volume', obs_date, ticker, volume FROM px WHERE {STOCKS} UNION ALL SELECT 'dividend', obs_date, ticker, value FROM idiv)",
)
FX = (
    "fx AS (SELECT CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS ccy, CAST(o_orderdate AS DATE) AS obs_date, round(1 + avg(c_acctbal) / 100000 + 3e-8, 6) AS value "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"
)


def facts(s: SparkSession, d: str) -> DataFrame:
    """Every field of every brand, indices' volumes and dividends included: the store leaves these out."""
    q = quotes(s, d).select("obs_date", "ticker", "close", F.col("low").alias("open"), "low", "high", F.col("volume").cast("double").alias("volume"))
    out = q.unpivot(["obs_date", "ticker"], ["close", "open", "low", "high", "volume"], "field", "value").select("obs_date", "ticker", "field", "value")
    return out.unionByName(dividends(s, d).select("obs_date", "ticker", F.lit("dividend").alias("field"), "value"))


def underlyings(s: SparkSession, d: str) -> DataFrame:
    last = F.substring("ticker", -1, 1).cast("int") % 5
    kind = F.when(last == 4, "INDEX").when(last == 3, "ETF").otherwise("STOCK")
    return instruments(s, d).select("ticker", kind.alias("instrument_type"), F.lit("EXCEL").alias("data_source"), "currency")


def opened(s: SparkSession, d: str, rows: DataFrame | None = None) -> PanelStore:
    out = PanelStore(s, scratch(s, "panel-store"))
    out.add(underlyings(s, d))
    out.upsert(facts(s, d) if rows is None else rows, created=DAY)
    return out


_shared: dict[tuple[str, str, str], PanelStore] = {}


def shared(s: SparkSession, d: str) -> PanelStore:
    """The store of all facts for queries that only read, written once for the tables as they are."""
    key = (s.sparkContext.applicationId, d, stamp(s, f"{d}/lineitem.parquet", f"{d}/part.parquet"))
    if key not in _shared or not exists(s, f"{_shared[key].path}/log"):
        _shared[key] = opened(s, d)
    return PanelStore(s, _shared[key].path)


def names(store: PanelStore) -> list[str]:
    return store.tickers()


def stored(store: PanelStore) -> DataFrame:
    return rounded(store.facts().select("field", "obs_date", "ticker", "value"))


def frame(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _dense(field: str, value: str, where: str = "true") -> str:
    """A dense panel of a field: dates on which any ticker has a value, with all tickers."""
    return f"SELECT '{field}' AS field, d.obs_date, names.ticker, x.value FROM (SELECT DISTINCT obs_date FROM st WHERE field = '{field}' AND {where}) d CROSS JOIN names LEFT JOIN (SELECT * FROM st WHERE field = '{field}') x ON x.obs_date = d.obs_date AND x.ticker = names.ticker"


@register("store_scan_fields", _sql(" UNION ALL ".join(f"SELECT field, obs_date, ticker, {_r('value')} FROM ({_dense(f, f)})" for f in ("open", "high", "low", "close", "volume", "dividend")), *ALL))
def _(s, d):
    st = shared(s, d)
    t = names(st)
    scans = {"open": st.open(t), "high": st.high(t), "low": st.low(t), "close": st.close(t), "volume": st.volume(t), "dividend": st.dividends(t)}
    out = None
    for field, scan in scans.items():
        rows = rounded(scan).select(F.lit(field).alias("field"), "obs_date", "ticker", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("store_scan_bounds_filled", _sql(
    f"SELECT obs_date, ticker, {_r(f'last_value(value IGNORE NULLS) {WT} ROWS UNBOUNDED PRECEDING)')} FROM g WHERE obs_date BETWEEN DATE '1994-03-01' AND DATE '1996-09-15'"
))
def _(s, d):
    st = shared(s, d)
    return rounded(st.get("close", names(st), start="1994-03-01", end="1996-09-15", ffill_na=True))


@register("store_scan_currency", _sql(
    f"SELECT g.obs_date, g.ticker, {_r('g.value * CASE WHEN g.ccy = 2 THEN 1.0 ELSE r.value END')} FROM (SELECT *, CAST(right(ticker, 1) AS INT) % 5 AS ccy FROM g) g ASOF LEFT JOIN fx r ON g.ccy = r.ccy AND g.obs_date >= r.obs_date", FX
))
def _(s, d):
    st = opened(s, d, facts(s, d).where("field = 'close'").unionByName(fx(s, d).select("obs_date", "ticker", F.lit("close").alias("field"), "value")))
    return rounded(st.close(names(st), currency="asia"))


@register("store_total_return", _sql(f"SELECT obs_date, ticker, {_r(f'CASE WHEN value IS NOT NULL THEN product(gr) {WT} ROWS UNBOUNDED PRECEDING) * p0 END')} FROM tg", IDIV, _TR[0].replace("LEFT JOIN div", "LEFT JOIN idiv AS div"), _TR[1]))
def _(s, d):
    st = shared(s, d)
    return rounded(st.total_return(names(st), withholding_tax=0.15, payers_only=True))


@register("liquidity", _sql(f"SELECT obs_date, ticker, {_r(f'CASE WHEN {STOCKS} THEN value * volume END')} FROM g"))
def _(s, d):
    st = shared(s, d)
    return rounded(st.liquidity(names(st)))


@register("observed_dates", _sql(
    "SELECT px.ticker, min(px.obs_date) AS oldest_obs_date, max(px.obs_date) AS latest_obs_date, max(px.obs_date) AS latest_obs_date_with_values, any_value(x.first_ex) AS first_ex_div_date, count(x.first_ex) > 0 AS has_dividend_history FROM px LEFT JOIN (SELECT ticker, min(obs_date) AS first_ex FROM idiv GROUP BY 1) x USING (ticker) GROUP BY 1",
    IDIV,
))
def _(s, d):
    return shared(s, d).observed()


@register("store_attributes", _sql(
    f"SELECT ticker, {CURRENCY} AS currency, {KIND} AS instrument_type, CASE WHEN {KIND} = 'ETF' THEN 'FUNDS' ELSE 'OTHER' END AS sector, (SELECT max(obs_date) FROM px p WHERE p.ticker = n.ticker) AS latest_obs_date, (SELECT min(obs_date) FROM idiv p WHERE p.ticker = n.ticker) AS first_ex_div_date FROM (SELECT DISTINCT upper(p_brand) AS ticker FROM part) n",
    IDIV,
))
def _(s, d):
    st = opened(s, d)
    st.update_attributes(underlyings(s, d).select("ticker", F.when(F.col("instrument_type") == "ETF", "FUNDS").otherwise("OTHER").alias("sector")))
    st.refresh_dates()
    return st.attributes(names(st), ["currency", "instrument_type", "sector", "latest_obs_date", "first_ex_div_date"])


@register("store_tickers_by_attribute", f"SELECT DISTINCT ticker FROM (SELECT upper(p_brand) AS ticker FROM part) WHERE {KIND} IN ('STOCK', 'ETF') AND {CURRENCY} = 'EUROPE'")
def _(s, d):
    st = PanelStore(s, scratch(s, "panel-store"))
    st.add(underlyings(s, d))
    return frame(s, [(t,) for t in st.tickers({"instrument_type": ["stock", "etf"], "currency": "europe"})], "ticker string")


@register("store_existence", f"SELECT ticker, CASE WHEN {KIND} = 'ETF' THEN 'other' WHEN ticker LIKE 'NO_%' THEN 'missing' ELSE 'there' END AS state FROM (SELECT DISTINCT upper(p_brand) AS ticker FROM part UNION ALL SELECT 'NO_1' UNION ALL SELECT 'NO_2')")
def _(s, d):
    st = PanelStore(s, scratch(s, "panel-store"))
    source = F.when(F.col("instrument_type") == "ETF", "YAHOO").otherwise("EXCEL")
    st.add(underlyings(s, d).withColumn("data_source", source))
    there, missing, other = st.existence([t.lower() for t in names(st)] + ["no_1", "no_2"], "excel")
    assert all(st.exists(t) for t in there[:2]) and not st.exists("NO_1")
    return frame(s, [(t, k) for k, ts in (("there", there), ("missing", missing), ("other", other)) for t in ts], "ticker string, state string")


@register("store_add_conflicts", f"SELECT ticker, CASE WHEN {KIND} = 'INDEX' THEN 'YAHOO' ELSE 'EXCEL' END AS data_source, {KIND} <> 'INDEX' AS has_facts FROM (SELECT DISTINCT upper(p_brand) AS ticker FROM part)")
def _(s, d):
    st = opened(s, d)
    again = underlyings(s, d).withColumn("data_source", F.lit("YAHOO"))
    st.add(again, "ignore")
    st.add(again.where("instrument_type = 'INDEX'"), "delete")
    held = st.facts().select("ticker").distinct().withColumn("f", F.lit(True))
    return st.instruments().join(held, "ticker", "left").select("ticker", "data_source", F.coalesce("f", F.lit(False)).alias("has_facts"))


@register("store_latest_dates", _sql("SELECT ticker, max(obs_date) AS latest FROM px GROUP BY 1"))
def _(s, d):
    return shared(s, d).latest_dates("close")


@register("store_eligible_start", _sql("SELECT least((SELECT min(m) FROM (SELECT max(obs_date) AS m FROM px GROUP BY ticker)), (SELECT min(m) FROM (SELECT max(obs_date) AS m FROM idiv GROUP BY ticker))) AS start", IDIV))
def _(s, d):
    st = shared(s, d)
    payers = [r[0] for r in underlyings(s, d).where("instrument_type <> 'INDEX'").collect()]
    closes, both = st.eligible_start(names(st)), st.eligible_start(payers, ["close", "dividend"])
    assert st.eligible_start(names(st), ["dividend"]) is None
    return frame(s, [(min(closes, both),)], "start date")


@register("store_stale", f"SELECT DISTINCT ticker FROM (SELECT upper(p_brand) AS ticker FROM part) WHERE {KIND} = 'ETF'")
def _(s, d):
    """Of the types that pay dividends, ETFs were last refreshed before the date."""
    st = PanelStore(s, scratch(s, "panel-store"))
    st.add(underlyings(s, d))
    st.record_refresh(st.tickers({"instrument_type": "stock"}), "dividend", dt.date(2024, 5, 2))
    st.record_refresh(st.tickers({"instrument_type": "etf"}), "dividend", dt.date(2024, 4, 30))
    return st.stale("dividend", dt.date(2024, 5, 1))


@register("store_active", _sql("SELECT ticker FROM px GROUP BY 1 HAVING date_diff('day', max(obs_date), (SELECT max(obs_date) FROM px)) <= 2"))
def _(s, d):
    st = shared(s, d)
    return st.active(st.facts("close").agg(F.max("obs_date")).first()[0], 2)


def _halves(s, d):
    """Everything up to 1996, then rows from 1995 on with other values."""
    rows = facts(s, d)
    late = rows.where("obs_date >= '1995-01-01' and day(obs_date) % 3 = 0").withColumn("value", F.col("value") + 1)
    return rows.where("obs_date < '1997-01-01'"), late


_EARLY = "early AS (SELECT * FROM st WHERE obs_date < DATE '1997-01-01')"
_LATE = "late AS (SELECT field, obs_date, ticker, value + 1 AS value FROM st WHERE obs_date >= DATE '1995-01-01' AND day(obs_date) % 3 = 0)"


@register("store_append", _sql(f"SELECT field, obs_date, ticker, {_r('value')} FROM (SELECT * FROM early UNION ALL SELECT * FROM late ANTI JOIN early USING (field, obs_date, ticker))", *ALL, _EARLY, _LATE))
def _(s, d):
    early, late = _halves(s, d)
    st = opened(s, d, early)
    st.upsert(late)
    return stored(st)


@register("store_replace_span", _sql(
    f"SELECT field, obs_date, ticker, {_r('value')} FROM (SELECT e.* FROM early e LEFT JOIN sp USING (field, ticker) WHERE lo IS NULL OR obs_date NOT BETWEEN lo AND hi UNION ALL SELECT * FROM late)",
    *ALL, _EARLY, _LATE, "sp AS (SELECT field, ticker, min(obs_date) AS lo, max(obs_date) AS hi FROM late GROUP BY 1, 2)",
))
def _(s, d):
    early, late = _halves(s, d)
    st = opened(s, d, early)
    st.upsert(late, replace=True)
    return stored(st)


@register("store_stream_exact", _sql(f"SELECT field, obs_date, ticker, {_r('value')} FROM (SELECT * FROM early ANTI JOIN late USING (field, obs_date, ticker) UNION ALL SELECT * FROM late)", *ALL, _EARLY, _LATE))
def _(s, d):
    from .streaming.upsert import upsert_stream

    early, late = _halves(s, d)
    st, folder = opened(s, d, early), scratch(s, "stream")
    late.write.parquet(f"{folder}/in")
    upsert_stream(s.readStream.schema(FACTS).parquet(f"{folder}/in"), st, f"{folder}/checkpoint").awaitTermination()
    return stored(st)


@register("store_delete", _sql(f"SELECT field, obs_date, ticker, {_r('value')} FROM st WHERE {KIND} <> 'ETF' AND NOT (field = 'close' AND {KIND} = 'INDEX' AND obs_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31') AND NOT (field = 'volume' AND obs_date = DATE '1996-03-04') AND NOT ({KIND} = 'STOCK' AND obs_date IN (DATE '1996-06-28', DATE '1999-06-30'))", *ALL))
def _(s, d):
    rows = facts(s, d)
    st = opened(s, d, rows.where("obs_date <> '1996-06-28'"))
    st.upsert(rows.where("obs_date = '1996-06-28'"), created=dt.date(1996, 6, 28))
    st.delete(st.tickers({"instrument_type": "etf"}))
    st.delete_facts("close", st.tickers({"instrument_type": "index"}), start="1995-01-01", end="1995-12-31")
    st.delete_facts("volume", names(st), dates=["1996-03-04"])
    st.delete_unsettled(st.tickers({"instrument_type": "stock"}))
    return stored(st)


@register("store_reset", _sql("SELECT (SELECT count(*) FROM st) AS facts_before, (SELECT count(DISTINCT upper(p_brand)) FROM part) AS instruments_before, (SELECT count(*) FROM st WHERE field = 'close') AS facts, 1::BIGINT AS instruments", *ALL).replace("(SELECT count(*) FROM st WHERE field = 'close') AS facts", "(SELECT count(*) FROM px WHERE ticker = 'BRAND#1') AS facts"))
def _(s, d):
    """A full store is emptied and cleaned up, and then takes the closes of one ticker."""
    st = opened(s, d)
    before = st.facts().agg(F.count("*").alias("facts_before")).first()[0], st.instruments().count()
    st.reset()
    st.vacuum()
    assert not st.facts().take(1) and not st.instruments().take(1)
    st.add(underlyings(s, d).where("ticker = 'BRAND#1'"))
    st.upsert(facts(s, d).where("ticker = 'BRAND#1' and field = 'close'"))
    return st.facts().agg(F.lit(before[0]).cast("long").alias("facts_before"), F.lit(before[1]).cast("long").alias("instruments_before"), F.count("*").alias("facts")).crossJoin(st.instruments().agg(F.count("*").alias("instruments")))


@register("store_ingest_refresh", _sql(
    f"SELECT field, obs_date, ticker, {_r('value')} FROM (SELECT * FROM early WHERE obs_date < (SELECT min(m) FROM (SELECT max(obs_date) AS m FROM early WHERE field = 'close' GROUP BY ticker)) UNION ALL "
    "SELECT field, obs_date, ticker, value FROM st WHERE obs_date >= (SELECT min(m) FROM (SELECT max(obs_date) AS m FROM early WHERE field = 'close' GROUP BY ticker)))",
    *ALL, _EARLY,
))
def _(s, d):
    """Ingested with what was there at the end of 1996, then refreshed from the least latest date on."""
    rows = facts(s, d).where("value <> 0")
    st = PanelStore(s, scratch(s, "panel-store"))
    t = [r[0] for r in underlyings(s, d).select("ticker").collect()]
    st.ingest(readers.FrameSource(rows.where("obs_date < '1997-01-01'"), underlyings(s, d)), t, today=DAY)
    st.refresh(readers.FrameSource(rows, underlyings(s, d)), t, today=DAY)
    return stored(st)


_LISTS = "ls AS (SELECT DISTINCT me.obs_date AS since, n.ticker FROM me, names n WHERE month(me.obs_date) IN (3, 9) AND (CAST(substr(n.ticker, 7) AS INT) + year(me.obs_date) + month(me.obs_date)) % 3 > 0)"


@register("getter_list_per_date", _sql(
    f"SELECT x.obs_date, x.ticker, {_r('x.v')} FROM (SELECT cal.obs_date, r.ticker, r.v, (SELECT max(since) FROM ls WHERE since <= cal.obs_date) AS since FROM cal JOIN (SELECT obs_date, ticker, CASE WHEN count(r) {WT} ROWS 39 PRECEDING) >= 40 THEN stddev_samp(r) {WT} ROWS 39 PRECEDING) * sqrt(252.0) END AS v FROM (SELECT obs_date, ticker, fv / lag(fv) {WT}) - 1 AS r FROM f)) r ON r.obs_date = cal.at) x JOIN ls USING (since, ticker)",
    "cal AS (SELECT me.obs_date, (SELECT max(days.obs_date) FROM days WHERE days.obs_date <= me.obs_date) AS at FROM (SELECT last_day(obs_date) AS obs_date FROM me) me)", _LISTS,
))
def getter_list_per_date(s, d):
    """Volatility over 40 rows of the tickers that stand in the list of each month's end; lists change twice a year, within windows too."""
    st = shared(s, d)
    ends = month_ends(panel(s, d))
    days = ends.where("month(obs_date) in (3, 9)").crossJoin(instruments(s, d).select("ticker").distinct())
    lists = days.where((F.substring("ticker", 7, 9).cast("int") + F.year("obs_date") + F.month("obs_date")) % 3 > 0)
    return rounded(DataGetter(st, lists, _calendar(s, d), policy="ffill", window=40).volatility())


@register("getter_types", _sql(
    " UNION ALL ".join(f"SELECT '{f}' AS data_type, obs_date, ticker, {_r('value')} FROM ({_dense(f, f).replace(f"'{f}' AS field, ", '')}) WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'" for f in ("open", "high", "low", "volume"))
    + f" UNION ALL SELECT 'liquidity', obs_date, ticker, {_r(f'CASE WHEN {STOCKS} THEN value * volume END')} FROM g WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
    *ALL,
))
def getter_types(s, d):
    """Every data type but the close through one door, for a year."""
    st, out = shared(s, d), None
    for kind in ("open", "high", "low", "volume", "liquidity"):
        rows = rounded(st.get(kind, names(st), start="1996-01-01", end="1996-12-31")).select(F.lit(kind).alias("data_type"), "obs_date", "ticker", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("vendor_ingest", _sql(
    f"SELECT st.field, st.obs_date, st.ticker, {_r('st.value')}, {KIND.replace('ticker', 'st.ticker')} AS instrument_type, {CURRENCY.replace('ticker', 'st.ticker')} AS currency, 'YAHOO' AS data_source FROM st WHERE NOT (st.field = 'dividend' AND st.value = 0) AND st.field <> 'low'", *ALL
))
def vendor_ingest(s, d):
    """A vendor's connection, asked in tasks for batches of tickers in its own notation: quotes, dividends and attributes, tidied, into a store.

    The connection answers from the panel's files, with gaps as NaN and days without a dividend as 0.
    """
    folder = scratch(s, "vendor")
    quoted = quotes(s, d).withColumn("Open", F.col("low")).join(dividends(s, d).withColumnRenamed("value", "Dividend"), ["obs_date", "ticker"], "left")
    quoted.select("obs_date", "ticker", "Open", F.col("high").alias("High"), F.col("close").alias("Close"), F.col("volume").cast("double").alias("Volume"), F.coalesce("Dividend", F.lit(0.0)).alias("Dividend")).write.parquet(f"{folder}/quotes")
    kinds = {"STOCK": "equity", "ETF": "etf", "INDEX": "index"}
    pairs = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    underlyings(s, d).select("ticker", pairs[F.col("instrument_type")].alias("kind"), F.lower("currency").alias("currency")).write.parquet(f"{folder}/info")

    def quotes_of(tickers, start, end):
        from pyarrow import dataset

        fs, path = file_system(f"{folder}/quotes")
        asked = dataset.field("ticker").isin([t.removesuffix(" EQUITY") for t in tickers])
        for batch in dataset.dataset(path, filesystem=fs, format="parquet").to_batches(filter=asked):
            for row in batch.to_pylist():
                if start is None or row["obs_date"] >= start:
                    yield from ((row["obs_date"], f"{row['ticker']} EQUITY", f, row[f]) for f in ("Open", "High", "Close", "Volume", "Dividend"))

    def info_of(tickers):
        from pyarrow import dataset

        fs, path = file_system(f"{folder}/info")
        held = {r["ticker"]: r for r in dataset.dataset(path, filesystem=fs, format="parquet").to_table().to_pylist()}
        return [(t, {"quoteType": held[k]["kind"], "currency": held[k]["currency"]}) for t in tickers if (k := t.removesuffix(" EQUITY")) in held]

    source = VendorSource(quotes_of, info_of, {"quoteType": "instrument_type", "currency": "currency"}, "YAHOO", to_vendor=text.add_suffix, batch=7, values={"equity": "STOCK"})
    st = PanelStore(s, scratch(s, "panel-store"))
    st.ingest(source, names(shared(s, d)), today=DAY)
    return stored(st).join(st.attributes(names(st), ["instrument_type", "currency", "data_source"]), "ticker")


@register("report_of_sheet", _sql(
    f"SELECT ticker, {_r('avg(ar)', 'mean_return')}, {_r('avg(av)', 'mean_volatility')}, {_r('min(dd)', 'maximum_drawdown')} FROM (SELECT ticker, fv / lag(fv, 252) {WT}) - 1 AS ar, CASE WHEN count(r) {WT} ROWS 251 PRECEDING) >= 252 THEN stddev_samp(r) {WT} ROWS 251 PRECEDING) END * sqrt(252.0) AS av, fv / max(fv) {WT} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT *, fv / lag(fv) {WT}) - 1 AS r FROM f WHERE obs_date NOT IN (SELECT obs_date FROM f WHERE fv IS NULL)) q) GROUP BY ticker"
))
def report_of_sheet(s, d):
    """Closes in a workbook's sheet become a report, written as a workbook and read again."""
    book, out = f"{scratch(s, 'levels')}.xlsx", scratch(s, "report")
    levels = clean.ffill(panel(s, d))
    readers.save_frames([levels.groupBy("obs_date").pivot("ticker").agg(F.first("value"))], ["levels"], full_path=book)
    report.report_of_sheet(s, book, "levels", out)
    back = readers.read_sheet(s, out, "Risk and return")
    return rounded(back.select("ticker", "mean_return", "mean_volatility", "maximum_drawdown"), "mean_return", "mean_volatility", "maximum_drawdown")


_RUNS = (
    "mb AS (SELECT obs_date, ticker FROM px WHERE close >= 948)",
    "nd AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS no FROM days)",
    "sr AS (SELECT ticker, min(obs_date) AS start, max(obs_date) AS \"end\" FROM (SELECT ticker, obs_date, no - row_number() OVER (PARTITION BY ticker ORDER BY no) AS run FROM mb JOIN nd USING (obs_date)) GROUP BY ticker, run)",
)


def _members(s, d) -> DataFrame:
    return quotes(s, d).where("close >= 948").select("obs_date", "ticker")


@register("membership_stretches", _sql('SELECT ticker, start, "end" FROM sr', *_RUNS))
def membership_stretches(s, d):
    return membership.stretches(_members(s, d), panel(s, d).select("obs_date"))


@register("membership_round_trip", _sql("SELECT e.obs_date, t.ticker, CASE WHEN mb.ticker IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM (SELECT max(obs_date) AS obs_date FROM days GROUP BY year(obs_date), quarter(obs_date)) e CROSS JOIN (SELECT DISTINCT ticker FROM mb WHERE obs_date IN (SELECT max(obs_date) FROM days GROUP BY year(obs_date), quarter(obs_date))) t LEFT JOIN mb ON mb.obs_date = e.obs_date AND mb.ticker = t.ticker WHERE e.obs_date >= (SELECT min(obs_date) FROM mb WHERE obs_date IN (SELECT max(obs_date) FROM days GROUP BY year(obs_date), quarter(obs_date)))", *_RUNS))
def membership_round_trip(s, d):
    """Members of days, folded to stretches, cut to quarters, exported as a sheet and loaded again."""
    calendar, folder = panel(s, d).select("obs_date").distinct(), scratch(s, "members")
    runs = membership.stretches(_members(s, d), calendar)
    membership.export(runs, calendar, folder, "Q")
    return membership.load_eligibility(s, folder)


_CHAIN = (
    "ct AS (SELECT DISTINCT upper(p_brand) AS ticker, CAST(substr(upper(p_brand), 7) AS INT) AS b FROM part)",
    "cn AS (SELECT ticker, 'G' || (b % 3) AS generic, DATE '1995-03-01' + b * 41 AS listed, DATE '1995-03-01' + b * 41 + 150 + (b * 97) % 700 AS expiry FROM ct)",
)


def _contracts(s, d) -> DataFrame:
    b = F.substring("ticker", 7, 9).cast("int")
    day = lambda n: F.date_add(F.lit("1995-03-01").cast("date"), n.cast("int"))
    return instruments(s, d).select("ticker", F.concat(F.lit("G"), b % 3).alias("generic"), day(b * 41).alias("listed"), day(b * 41 + 150 + (b * 97) % 700).alias("expiry"))


@register("futures_chain", _sql(
    "SELECT obs_date, generic, CAST(position AS INTEGER) AS position, ticker FROM (SELECT d.obs_date, generic, ticker, row_number() OVER (PARTITION BY d.obs_date, generic ORDER BY expiry, ticker) AS position FROM days d JOIN cn ON d.obs_date BETWEEN listed AND expiry) WHERE position <= 3", *_CHAIN
))
def futures_chain(s, d):
    """The three nearest live contracts of each generic ticker on every date; late listings move the others back."""
    source = readers.FrameSource(facts(s, d), underlyings(s, d), chains=_contracts(s, d))
    days, out = panel(s, d).select("obs_date").distinct(), None
    for g in ("g0", "g1", "g2"):
        rows = source.futures_chain(g, days, 3)
        out = rows if out is None else out.unionAll(rows)
    return out


_Y = "DATE '1998-01-01'"
_WITHIN = f"mw AS (SELECT obs_date FROM me WHERE obs_date BETWEEN {_Y} AND DATE '1998-12-31')"


@register("back_test_pruned", _sql(
    f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", _WITHIN, RET,
    f"el8 AS (SELECT obs_date, ticker, CASE WHEN n >= 12 THEN 1.0::DOUBLE END AS value FROM (SELECT *, count(value) {WT} ROWS 19 PRECEDING) AS n FROM g) WHERE obs_date IN (SELECT obs_date FROM mw))",
    _stale(f"CASE WHEN ({_vol(40)}) IS NOT NULL THEN ({_vol(40)}) END", "ret", "v40"),
    "rk AS (SELECT el8.obs_date, el8.ticker, el8.value, row_number() OVER (PARTITION BY el8.obs_date ORDER BY CASE WHEN el8.value IS NOT NULL THEN v40.value END NULLS LAST, el8.ticker) AS k, v40.value AS v FROM el8 LEFT JOIN v40 USING (obs_date, ticker))",
    "sg AS (SELECT obs_date, ticker, v, CASE WHEN k <= 5 AND value IS NOT NULL AND v IS NOT NULL THEN 1.0::DOUBLE END AS s FROM rk)",
    "wt AS (SELECT obs_date, ticker, coalesce(x / sum(x) OVER (PARTITION BY obs_date), 0) AS value FROM (SELECT *, CASE WHEN s = 1 AND v > 0 THEN 1 / v END AS x FROM sg))",
    "dm AS (SELECT days.obs_date, max(mw.obs_date) AS at FROM days JOIN mw ON mw.obs_date <= days.obs_date WHERE days.obs_date <= DATE '1998-12-31' GROUP BY 1)",
    f"bw AS (SELECT f.obs_date, f.ticker, f.fv / lag(f.fv) {WT.replace('ticker ORDER BY obs_date', 'f.ticker ORDER BY f.obs_date')}) - 1 AS ret, wt.value AS weight FROM f JOIN dm USING (obs_date) JOIN wt ON wt.obs_date = dm.at AND wt.ticker = f.ticker)",
    *_index(2, 0, 0, "bw"),
))
def back_test_pruned(s, d):
    """A year of an index; the store opens this year and what the parts look back to, and nothing else."""
    st = shared(s, d)
    close = StoredPanel(st, names(st))
    year = month_ends(panel(s, d)).where("year(obs_date) = 1998")
    universe = strategy.Universe(names(st), year).price_history(close, 20, 0.6)
    test = strategy.Strategy(strategy.volatility_rank(universe, close, 40, number=5), strategy.by_volatility(close, 40), close)
    out = test.back_test(end="1998-12-31")
    opened_years = {f.split("/year=")[1].split("/")[0] for f in out.inputFiles() if "/facts/" in f}
    assert opened_years == {"1997", "1998"}, opened_years
    return rounded(out)


@register("store_statistics", _sql(
    "SELECT field, ticker, min(obs_date) AS first, max(obs_date) AS last FROM late2 GROUP BY 1, 2",
    *ALL, "late2 AS (SELECT * FROM st WHERE NOT (field = 'close' AND right(ticker, 1) = '2' AND obs_date >= DATE '1999-05-01'))",
))
def store_statistics(s, d):
    """First and last dates by field and ticker from the batches' summaries: no fact is read but those of tickers that rows were deleted of."""
    st = opened(s, d)
    assert not any("/facts/" in f for f in st.observed().inputFiles())
    st.delete_facts("close", underlyings(s, d).where("ticker like '%2'"), start="1999-05-01")
    return st.dates()


@register("store_scan_pruned", _sql(f"SELECT obs_date, ticker, {_r('close')} FROM px WHERE ticker IN ('BRAND#7', 'BRAND#8') AND obs_date >= DATE '1997-01-01'"))
def store_scan_pruned(s, d):
    """Two tickers of a store whose partitions have several slots: the summaries name the few slots that hold them."""
    st = PanelStore(s, scratch(s, "panel-store"), slot_rows=5000)
    st.add(underlyings(s, d))
    st.upsert(facts(s, d).where("field = 'close'"), created=DAY)
    asked = s.createDataFrame([("brand#7",), ("BRAND#8",)], "ticker string")
    rows = st.facts("close", "1997-01-01", tickers=asked)
    assert len(rows.inputFiles()) < len(st.facts("close", "1997-01-01").inputFiles()) or len(st.facts("close").inputFiles()) < 12
    return rounded(rows.select("obs_date", "ticker", "value"))


@register("store_merged_on_read", _sql(
    f"SELECT field, obs_date, ticker, {_r('value')} FROM (SELECT field, obs_date, ticker, CASE WHEN field = 'close' AND day(obs_date) % 5 = 0 THEN value + 3 WHEN field = 'close' AND day(obs_date) % 3 = 0 THEN value + 1 ELSE value END AS value FROM st WHERE NOT (field = 'volume' AND month(obs_date) = 2 AND year(obs_date) = 1998)) WHERE field <> 'low'",
    *ALL,
))
def store_merged_on_read(s, d):
    """Several batches and deletions, read as they lie; then folded, which must change nothing."""
    rows = facts(s, d)
    st = opened(s, d)
    for every, add in ((3, 1), (5, 3)):
        st.upsert(rows.where(f"field = 'close' and day(obs_date) % {every} = 0").withColumn("value", F.col("value") + add), replace="exact")
    st.upsert(rows.withColumn("value", F.col("value") - 1))  # stays behind what is there
    st.delete_facts("volume", names(st), start="1998-02-01", end="1998-02-28")
    st.delete_facts("low", names(st))
    before = st.facts().agg(F.count("*"), F.round(F.sum("value"), 2)).first()
    st.compact("close")
    assert st.facts().agg(F.count("*"), F.round(F.sum("value"), 2)).first() == before
    return stored(st)


@register("store_stream_versions", _sql(
    f"SELECT field, obs_date, ticker, {_r('value')} FROM (SELECT field, obs_date, ticker, arg_max(value, {{'v': version, 'x': value}}) AS value FROM (SELECT field, obs_date, ticker, value + k AS value, k % 3 AS version FROM st, (VALUES (1), (2), (3), (5)) AS v(k) WHERE field = 'close') GROUP BY 1, 2, 3)",
    *ALL,
))
def store_stream_versions(s, d):
    """A stream of several versions of each fact, within a batch, late and replayed: the greatest version counts, of equal ones the greater value."""
    from .streaming.upsert import upsert_stream

    folder, st = scratch(s, "stream"), PanelStore(s, scratch(s, "panel-store"))
    st.add(underlyings(s, d))
    rows = facts(s, d).where("field = 'close'")
    schema = FACTS + ", version long"
    for batch in ((2, 3), (1, 5), (3,)):
        new = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in batch])))
        new.select("obs_date", "ticker", "field", (F.col("value") + F.col("k")).alias("value"), (F.col("k") % 3).cast("long").alias("version")).write.mode("append").parquet(f"{folder}/in")
        upsert_stream(s.readStream.schema(schema).parquet(f"{folder}/in"), st, f"{folder}/checkpoint", order="version").awaitTermination()
    return stored(st)


_MAP = "cal AS (SELECT me.obs_date, (SELECT max(days.obs_date) FROM days WHERE days.obs_date <= me.obs_date) AS at FROM (SELECT last_day(obs_date) AS obs_date FROM me) me)"


def _calendar(s, d):
    return month_ends(panel(s, d)).select(F.last_day("obs_date").alias("obs_date"))


def _getter(s, d, **how) -> DataGetter:
    st = shared(s, d)
    return DataGetter(st, names(st), _calendar(s, d), **how)


@register("getter_data", _sql(f"SELECT obs_date, ticker, {_r(f'fv / lag(fv, 5) {WT}) - 1')} FROM f WHERE isodow(obs_date) = 3".replace("FROM f WHERE", "FROM (SELECT obs_date, ticker, last_value(value IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS fv FROM g WHERE isodow(obs_date) = 3) WHERE")))
def _(s, d):
    return rounded(_getter(s, d, freq="wednesday", policy="ffill").data(5))


@register("getter_holding_period_return", _sql(f"SELECT cal.obs_date, x.ticker, {_r('x.v')} FROM cal JOIN (SELECT obs_date, ticker, fv / lag(fv, 20) {WT}) - 1 AS v FROM f) x ON x.obs_date = cal.at", _MAP))
def _(s, d):
    return rounded(_getter(s, d, policy="ffill", window=20).holding_period_return())


@register("getter_volatility", _sql(
    f"SELECT cal.obs_date, x.ticker, {_r('x.v')} FROM cal JOIN (SELECT obs_date, ticker, CASE WHEN count(r) {WT} ROWS 19 PRECEDING) >= 20 THEN stddev_samp(r) {WT} ROWS 19 PRECEDING) * sqrt(252.0) END AS v FROM (SELECT obs_date, ticker, fv / lag(fv) {WT}) - 1 AS r FROM f)) x ON x.obs_date = cal.at",
    _MAP,
))
def _(s, d):
    return rounded(_getter(s, d, policy="ffill", window=20).volatility())


@register("getter_beta", _sql(
    f"SELECT cal.obs_date, x.ticker, {_r('x.v')} FROM cal JOIN (SELECT obs_date, ticker, CASE WHEN count(r + b) {WT} ROWS 29 PRECEDING) >= 30 THEN covar_samp(r, b) {WT} ROWS 29 PRECEDING) / var_samp(CASE WHEN r IS NOT NULL THEN b END) {WT} ROWS 29 PRECEDING) END AS v "
    "FROM fr JOIN (SELECT obs_date, r AS b FROM fr WHERE ticker = (SELECT min(ticker) FROM names)) USING (obs_date)) x ON x.obs_date = cal.at",
    _MAP, f"fr AS (SELECT obs_date, ticker, fv / lag(fv) {WT}) - 1 AS r FROM f)",
))
def _(s, d):
    g = _getter(s, d, policy="ffill", window=30)
    return rounded(g.beta(min(g.tickers)))


# sources


@register("workbook_round_trip", _sql(f"SELECT field, obs_date, ticker, {_r('value')} FROM st WHERE field <> 'open' AND NOT (field = 'dividend' AND value = 0) ORDER BY ALL", ALL[0].replace(f" WHERE {STOCKS}", ""), ALL[1].replace(f" WHERE {STOCKS}", "")))
def _(s, d):
    """A sheet per field, written wide by the report writer and read by the workbook source."""
    folder, q = scratch(s, "workbook"), quotes(s, d)
    fields = {"close_price": "close", "low_price": "low", "high_price": "high", "volume": "volume"}
    wide = {sheet: q.groupBy("obs_date").pivot("ticker").agg(F.first(c)) for sheet, c in fields.items()}
    wide["dividend"] = dividends(s, d).groupBy("obs_date").pivot("ticker").agg(F.first("value"))
    readers.write_report(wide, folder, "csv")
    return rounded(readers.WorkbookSource(folder).facts(s).select("field", "obs_date", "ticker", "value"))


@register("workbook_instruments", f"SELECT ticker, {KIND} AS instrument_type, replace(upper(name), ' ', '_') AS sector FROM (SELECT upper(p_brand) AS ticker, min(p_type) AS name FROM part GROUP BY 1)")
def _(s, d):
    folder = scratch(s, "workbook")
    named = table(s, d, "part").groupBy(F.upper("p_brand").alias("ticker")).agg(F.min("p_type").alias("sector"))
    readers.write_report({"underlying": underlyings(s, d).select("ticker", "instrument_type").join(named, "ticker")}, folder, "csv")
    assert readers.list_tables(s, folder, ".csv") == ["underlying.csv"]
    return readers.WorkbookSource(folder).instruments(s)


@register("sheet_round_trip", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    folder = scratch(s, "report")
    readers.write_report({"names of nations, shortened to so many": table(s, d, "nation").select("n_nationkey", "n_name")}, folder)
    return readers.read_sheet(s, folder, "names of nations, shortened to so many")


@register("dividends_tidied", _sql(f"SELECT obs_date, ticker, {_r('2 * value')} FROM div WHERE obs_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"))
def _(s, d):
    one = dividends(s, d)
    return rounded(readers.tidy_dividends(one.unionAll(one), "1994-01-01", "1996-12-31"))


@register("reference_data", "SELECT upper(p_brand) AS ticker, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS kinds, string_agg(DISTINCT p_size::VARCHAR, ' ' ORDER BY p_size::VARCHAR) AS sizes FROM part GROUP BY 1")
def _(s, d):
    p = table(s, d, "part").select(F.upper("p_brand").alias("ticker"), "p_type", F.col("p_size").cast("string").alias("size"))
    rows = p.select("ticker", F.lit("kinds").alias("field"), F.col("p_type").alias("value")).unionAll(p.select("ticker", F.lit("sizes"), "size")).distinct()
    return readers.reference_data(rows, ["kinds", "sizes"])


@register("vendor_attributes", f"SELECT ticker, CASE WHEN {KIND} = 'STOCK' THEN 'EQUITY' ELSE {KIND} END AS instrument_type, {CURRENCY} AS currency, 'NA' AS country FROM (SELECT DISTINCT upper(p_brand) AS ticker FROM part)")
def _(s, d):
    info = underlyings(s, d).select(F.lower("ticker").alias("ticker"), F.create_map(F.lit("quoteType"), F.lower("instrument_type"), F.lit("money"), F.lower("currency")).alias("info"))
    return readers.instruments_from_info(info, {"quoteType": "instrument_type", "money": "currency", "country": "country"}, {"stock": "equity"})


@register("index_members", _sql("SELECT DISTINCT ticker FROM px WHERE volume > 40"))
def _(s, d):
    members = quotes(s, d).where("volume > 40").select(F.lit("WIDE").alias("index_ticker"), "ticker").distinct()
    other = members.withColumn("index_ticker", F.lit("OTHER")).limit(3)
    return readers.FrameSource(facts(s, d), underlyings(s, d), index_members=members.unionAll(other)).index_members("wide").select("ticker")


# names, calendars, cross-sections


@register("text_functions", """
SELECT DISTINCT p_brand AS brand, upper(replace(p_type, ' ', '_')) AS attribute, p_type || ' INDEX' AS suffixed, p_type AS bare, 'EUR' || p_size || ' BGN CURNCY' AS terminal,
  p_size::VARCHAR || '|' || p_brand AS listed, true AS number, false AS word, CASE WHEN p_size > 9 AND p_size < 29 THEN CAST('2024-03-' || p_size AS DATE) END AS expiry FROM part
""")
def _(s, d):
    p = table(s, d, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("size"), "p_size").distinct()
    tail = F.concat(F.lit("EXPIRY "), F.when((F.col("p_size") > 9) & (F.col("p_size") < 29), F.concat(F.lit("2024-03-"), F.col("size"))).otherwise("open"))
    return p.select(
        F.col("p_brand").alias("brand"),
        text.attribute(F.col("p_type")).alias("attribute"),
        text.add_suffix(F.concat(F.lower("p_type"), F.lit(" index"))).alias("suffixed"),
        text.remove_suffix(F.concat(F.col("p_type"), F.lit(" equity"))).alias("bare"),
        text.fx_to_terminal(text.fx_ticker(F.col("size"), F.lit("eur"))).alias("terminal"),
        F.array_join(text.split_list(F.concat(F.lit("  "), F.col("size"), F.lit(" , "), F.col("p_brand"), F.lit(" "))), "|").alias("listed"),
        text.is_number(F.col("size")).alias("number"),
        text.is_number(F.col("p_brand")).alias("word"),
        text.expiry_of(tail).alias("expiry"),
    )


@register("tickers_joined", "SELECT p_type, string_agg(DISTINCT upper(p_brand), ' ' ORDER BY upper(p_brand)) AS tickers FROM part GROUP BY 1")
def _(s, d):
    return table(s, d, "part").select("p_type", F.upper("p_brand").alias("b")).distinct().groupBy("p_type").agg(text.join_tickers(F.col("b")).alias("tickers"))


_SPAN = "(SELECT min(obs_date) AS a, max(obs_date) AS b FROM px)"


@register("calendar_ranges", _sql(
    f"SELECT 'B' AS freq, CAST(r AS DATE) AS obs_date FROM (SELECT unnest(range(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS r FROM {_SPAN}) WHERE isodow(r) <= 5 "
    f"UNION ALL SELECT 'M', last_day(CAST(r AS DATE)) FROM (SELECT unnest(range(date_trunc('month', a), b + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS r, b FROM {_SPAN}) WHERE last_day(CAST(r AS DATE)) <= b "
    f"UNION ALL SELECT 'BM', m FROM (SELECT last_day(CAST(r AS DATE)) - CAST(greatest(isodow(last_day(CAST(r AS DATE))) - 5, 0) AS INT) AS m, b FROM (SELECT unnest(range(date_trunc('month', a), b + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS r, b FROM {_SPAN})) WHERE m <= b"
))
def _(s, d):
    """Calendars over the span of the quotes."""
    a, b = quotes(s, d).agg(F.min("obs_date"), F.max("obs_date")).first()
    out = None
    for freq in ("B", "M", "BM"):
        one = calendar.date_range(s, str(a), str(b), freq=freq).select(F.lit(freq).alias("freq"), "obs_date")
        out = one if out is None else out.unionByName(one)
    return out


@register("panels_aggregated", _sql(f"SELECT obs_date, ticker, {_r('CASE WHEN value + volume IS NOT NULL THEN greatest(value, volume) END', 'greatest')}, {_r('CASE WHEN value + volume IS NOT NULL THEN least(value, volume) END', 'least')} FROM g"))
def _(s, d):
    two = [panel(s, d), panel(s, d, "volume").withColumn("value", F.col("value").cast("double"))]
    big, small = (cross.aggregate(two, how).withColumnRenamed("value", n) for how, n in (("max", "greatest"), ("min", "least")))
    return rounded(big.join(small, ["obs_date", "ticker"]), "greatest", "least")


@register("panel_checks", _sql("SELECT true AS signs, false AS one_value, true AS same, false AS differs, 252 / 5.0 AS weekly, 126.0 AS second"))
def _(s, d):
    p = panel(s, d)
    sign = p.withColumn("value", F.signum(F.col("value") - 950))
    rows = (cross.only_values(sign, -1.0, 0.0, 1.0), cross.all_equal(p), cross.same_shape(p, sign), cross.same_shape(p, p.where("day(obs_date) > 1")), cross.annualization_factor("friday"), cross.annualization_factor(2))
    return frame(s, [rows], "signs boolean, one_value boolean, same boolean, differs boolean, weekly double, second double")


@register("distinct_values", _sql("SELECT DISTINCT sign(value - 950)::DOUBLE AS value FROM g"))
def _(s, d):
    return cross.distinct_values(panel(s, d).withColumn("value", F.signum(F.col("value") - 950)))


@register("mean_per_ticker", _sql(f"SELECT ticker, {_r('avg(value)')} FROM g GROUP BY 1"))
def _(s, d):
    return rounded(cross.mean(panel(s, d)))


@register("realized_volatility_dense", _sql(f"SELECT obs_date, ticker, {_r(f'CASE WHEN count(r) {WT} ROWS 19 PRECEDING) >= 20 THEN stddev_samp(r) {WT} ROWS 19 PRECEDING) * sqrt(252.0) END')} FROM (SELECT obs_date, ticker, value / lag(value) {WT}) - 1 AS r FROM g)"))
def _(s, d):
    return rounded(rolling.realized_volatility(panel(s, d), 1, 20))


@register("futures_universe", """
SELECT 'CO' || (CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'Z' ELSE 'G' END) || p_partkey AS ticker, DATE '1996-01-01' + p_size * 30 AS expiry FROM part
WHERE p_size % 3 < 2 AND DATE '1996-01-01' + p_size * 30 > DATE '1997-01-01' AND DATE '1995-01-01' + p_size * 30 < DATE '1999-01-01'
""")
def _(s, d):
    code = F.element_at(F.array(F.lit("F"), F.lit("Z"), F.lit("G")), F.col("p_size") % 3 + 1)
    shift = lambda day: F.date_add(F.lit(day).cast("date"), F.col("p_size") * 30)
    rows = table(s, d, "part").select(
        F.concat(F.lit("CO"), code, F.col("p_partkey")).alias("ticker"), F.lit("FUTURE").alias("instrument_type"),
        F.concat(F.lit("EXPIRY "), shift("1996-01-01")).alias("description"), shift("1996-01-01").alias("latest_obs_date"), shift("1995-01-01").alias("oldest_obs_date"),
    )
    return futures.universe(rows, "co", ["f", "z"], "1997-01-01", "1999-01-01").select("ticker", "expiry")


@register("roll_calendar", """
SELECT ticker, s AS roll_start, e AS roll_end, expiry FROM (SELECT ticker, expiry,
  (SELECT d FROM (SELECT CAST(range AS DATE) AS d, row_number() OVER (ORDER BY range DESC) AS n FROM range(x.expiry - INTERVAL 20 DAY, x.expiry, INTERVAL 1 DAY) WHERE isodow(range) <= 5) WHERE n = 6) AS s,
  (SELECT d FROM (SELECT CAST(range AS DATE) AS d, row_number() OVER (ORDER BY range DESC) AS n FROM range(x.expiry - INTERVAL 20 DAY, x.expiry, INTERVAL 1 DAY) WHERE isodow(range) <= 5) WHERE n = 1) AS e
  FROM (SELECT 'F' || o_orderkey AS ticker, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE isodow(o_orderdate) <= 5) x)
""")
def _(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("F"), F.col("o_orderkey")).alias("ticker"), F.to_date("o_orderdate").alias("expiry")).where("weekday(expiry) < 5")
    return futures.roll_calendar(o, 5, 1)


@register("futures_contracts_updated", """
SELECT 'CO' || p_partkey AS ticker, 'EXPIRY ' || strftime(DATE '1996-01-01' + p_size * 30, '%Y-%m-%d') AS description, 3::BIGINT AS n FROM part
""")
def _(s, d):
    """Every part a contract with three closes; what the store holds of it after the update."""
    p = table(s, d, "part").select(F.concat(F.lit("CO"), "p_partkey").alias("ticker"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("p_size") * 30).alias("expiry"))
    rows = p.select(F.explode(F.sequence(F.date_sub("expiry", 3), F.date_sub("expiry", 1))).alias("obs_date"), "ticker", F.lit("close").alias("field"), F.lit(5.0).alias("value"))
    known = p.select("ticker", F.lit("FUTURE").alias("instrument_type"), F.lit("EXCEL").alias("data_source"), F.lit("USD").alias("currency"), F.lit("none").alias("description"))
    st = PanelStore(s, scratch(s, "panel-store"))
    futures.update_contracts(st, readers.FrameSource(rows, known), p.select("ticker"), p, DAY)
    n = st.facts("close").groupBy("ticker").agg(F.count("*").alias("n"))
    return st.instruments().select("ticker", "description").join(n, "ticker")


@register("rolling_strategy_names", """
SELECT ticker AS brand, CASE WHEN even THEN 'CO' ELSE 'S ' END AS code, (CASE WHEN even THEN 'BRENT_CRUDE_OIL' ELSE 'SOYBEANS' END) || '_' || side || '_' || n || '_FUT INDEX' AS ticker,
       (CASE WHEN even THEN 'Brent Crude Oil' ELSE 'Soybeans' END) || ' rolling futures strategy. ' || side || ' ' || share || '.0% ' || n || (CASE n WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END) || ' future.' AS description,
       CASE WHEN even THEN 'H K N U X F' ELSE 'H K N X F' END AS months
FROM (SELECT ticker, b % 2 = 0 AS even, b % 5 + 1 AS n, CASE WHEN b % 3 = 0 THEN 'SHORT' ELSE 'LONG' END AS side, 10 + b AS share FROM (SELECT DISTINCT upper(p_brand) AS ticker, CAST(substr(p_brand, 7) AS INT) AS b FROM part))
""")
def _(s, d):
    """A strategy for each brand: its number gives the commodity, the contract and the allocation."""
    rows = []
    for r in instruments(s, d).select("ticker").distinct().orderBy("ticker").collect():  # 25 brands
        b = int(r["ticker"][6:])
        code = "CO" if b % 2 == 0 else "S "
        rows.append((r["ticker"], code, *futures.named(code.lower(), {b % 5 + 1: (10 + b) / 100 * (-1 if b % 3 == 0 else 1)}), " ".join(futures.roll_months(code))))
    return frame(s, rows, "brand string, code string, ticker string, description string, months string")


_NTH = "(SELECT d FROM (SELECT CAST(range AS DATE) AS d, row_number() OVER (ORDER BY range DESC) AS k FROM range(lo - INTERVAL 900 DAY, lo, INTERVAL 1 DAY) WHERE isodow(range) <= 5) WHERE k = {})"


@register("look_back_spans", _sql(
    "SELECT w, min(obs_date) AS first, max(obs_date) AS last, count(*) AS n FROM (SELECT 'daily' AS w, g.obs_date FROM g CROSS JOIN lo WHERE obs_date >= " + _NTH.format(75)
    + " UNION ALL SELECT 'weekly', g.obs_date FROM g CROSS JOIN lo WHERE obs_date >= " + _NTH.format(200) + " UNION ALL SELECT 'every fifth', g.obs_date FROM g CROSS JOIN lo WHERE obs_date >= " + _NTH.format(195)
    + ") x CROSS JOIN lo WHERE obs_date <= hi GROUP BY 1",
    "lo AS (SELECT min(obs_date) AS lo, max(obs_date) AS hi FROM me WHERE obs_date >= DATE '1995-06-15')",
))
def _(s, d):
    p = panel(s, d)
    sig = month_ends(p).where("obs_date >= '1995-06-15'")
    out = None
    for name, how in (("daily", ([20, 60], 1, False)), ("weekly", (20, "friday", False)), ("every fifth", (20, 5, True))):
        cut = strategy.pruned(p, sig, *how).agg(F.lit(name).alias("w"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last"), F.count("*").alias("n"))
        out = cut if out is None else out.unionByName(cut)
    return out


@register("strategy_described", """
SELECT * FROM (SELECT 0 AS position, 'Index eligibility:' AS item, '0.6 of the last ' || (SELECT 4 * count(*) FROM region) || ' closes' AS description UNION ALL SELECT 1, 'Currency:', (SELECT replace(max(r_name), ' ', '_') FROM region)
UNION ALL SELECT 2, 'Return type:', 'Total return' UNION ALL SELECT 3, 'Dividend tax:', '15.0%' UNION ALL SELECT 4, 'Signal:', 'SmaCross' UNION ALL SELECT 5, 'Weight:', 'equal_weight' UNION ALL SELECT 6, 'Overlay:', 'VolatilityTarget'
UNION ALL SELECT 7, 'Index fee p.a.:', (SELECT count(*) FROM region) || '.0%' UNION ALL SELECT 8, 'Transaction costs:', '0.1%' UNION ALL SELECT 9, 'Weight observation lag (days):', '2')
""")
def _(s, d):
    """The parameters are those of the tables: as many closes, percent and currencies as there are regions."""
    p, r = panel(s, d), table(s, d, "region").agg(F.count("*"), F.max("r_name")).first()
    u = strategy.Universe(names(shared(s, d)), month_ends(p)).price_history(p, 4 * r[0], 0.6)
    st = strategy.Strategy(strategy.SmaCross(u.eligibility(), p, 20, 5), strategy.equal_weight, p, strategy.VolatilityTarget(0.1), fee=r[0] / 100, transaction_cost=0.001)
    return st.describe_table(u, r[1].replace(" ", "_").lower(), True, 0.15)


@register("xlsx_round_trip", _sql(f"SELECT field, obs_date, ticker, {_r('value')} FROM st WHERE field IN ('close', 'dividend')", IDIV.replace(f" WHERE {STOCKS}", ""), ALL[1].replace(f" WHERE {STOCKS}", "")))
def _(s, d):
    """Closes and dividends as sheets of one .xlsx file."""
    path = f"{scratch(s, 'workbook')}.xlsx"
    wide = {"close_price": quotes(s, d).groupBy("obs_date").pivot("ticker").agg(F.first("close")), "dividend": dividends(s, d).groupBy("obs_date").pivot("ticker").agg(F.first("value"))}
    readers.write_report(wide, path)
    return rounded(readers.WorkbookSource(path).facts(s).select("field", "obs_date", "ticker", "value"))


@register("xlsx_ingest", f"SELECT ticker, {KIND} AS instrument_type, 'EXCEL' AS data_source, 'A&B_<{KIND}>' AS sector FROM (SELECT DISTINCT upper(p_brand) AS ticker FROM part)".replace(f"'A&B_<{KIND}>'", f"'A&B_<' || {KIND} || '>'"))
def _(s, d):
    """Instruments of a workbook's sheet, added to a store."""
    path, st = f"{scratch(s, 'workbook')}.xlsx", PanelStore(s, scratch(s, "panel-store"))
    sheet = underlyings(s, d).select("ticker", "instrument_type", "data_source", F.concat(F.lit("a&b <"), "instrument_type", F.lit(">")).alias("sector"))
    readers.write_report({"underlying": sheet, "empty": sheet.limit(0)}, path)
    book = readers.WorkbookSource(path)
    assert book.sheet(s, "empty") is None and book.sheet(s, "missing") is None
    t = [r[0] for r in sheet.select("ticker").collect()]
    st.ingest(book, t, refresh=False)
    return st.attributes(t, ["instrument_type", "data_source", "sector"])
