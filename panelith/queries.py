"""Registered queries of the panel operators, each beside independent SQL for the same result.

The panels come from the star schema: a ticker is a brand, its close the mean retail price of what was shipped on a date. Averages are
rounded after a small shift, so that both engines round the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import calendar, text
from .operators import asof, clean, cross, rolling
from .operators.frames import dense
from .plans import futures, report, strategy
from .sources import readers, store
from .sources.shared import exists, scratch, stamp

SHIFT = 3e-8


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("value",):
        df = df.withColumn(c, F.round(F.col(c) + SHIFT, 6))
    return df


_stored: dict[tuple[str, str, str], str] = {}


def built_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """obs_date, ticker, close, low, high, volume on weekdays, from the star schema."""
    part = _table(spark, sf, "part").select("p_partkey", F.upper("p_brand").alias("ticker"), "p_retailprice")
    line = _table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("obs_date"), "l_quantity").where(~F.dayofweek("obs_date").isin(1, 7))
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("obs_date", "ticker").agg(F.round(F.avg("p_retailprice") + SHIFT, 6).alias("close"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.sum("l_quantity").alias("volume"))


def wide_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The dense panel of all fields, stored once for the tables as they are: queries read it as a user reads a stored panel."""
    key = (spark.sparkContext.applicationId, sf, stamp(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet"))
    if key not in _stored or not exists(spark, f"{_stored[key]}/_SUCCESS"):
        path = scratch(spark, "panel")
        dense(built_quotes(spark, sf)).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the panel that hold a quote."""
    return wide_panel(spark, sf).where("close is not null")


def panel(spark: SparkSession, sf: str, field: str = "close") -> DataFrame:
    return wide_panel(spark, sf).select("obs_date", "ticker", F.col(field).alias("value"))


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    """Half a percent of the close on a quarter's first date."""
    w = Window.partitionBy("ticker", F.year("obs_date"), F.quarter("obs_date")).orderBy("obs_date")
    q = quotes(spark, sf).select("obs_date", "ticker", "close")
    return q.withColumn("n", F.row_number().over(w)).where("n = 1").select("obs_date", "ticker", F.round(0.005 * F.col("close"), 6).alias("value"))


def market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quotes(spark, sf).groupBy("obs_date").agg(F.avg("close").alias("value")))


def fx(spark: SparkSession, sf: str) -> DataFrame:
    """One rate per region and order date."""
    o, c, n, r = (_table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    named = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.upper(F.regexp_replace("r_name", " ", "_")).alias("ccy"))
    both = o.select("o_custkey", F.to_date("o_orderdate").alias("obs_date")).join(c.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey"))
    rate = both.groupBy("obs_date", "ccy").agg(F.round(1 + F.avg("c_acctbal") / 100000 + SHIFT, 6).alias("value"))
    return rate.select("obs_date", text.fx_ticker(F.lit("ASIA"), F.col("ccy")).alias("ticker"), "value")


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Tickers with a currency each, by their brand's last digit."""
    names = _table(spark, sf, "part").select(F.upper("p_brand").alias("ticker")).distinct()
    regions = F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE_EAST")])
    return names.select("ticker", F.element_at(regions, (F.substring("ticker", -1, 1).cast("int") % 5 + 1)).alias("currency"))


def month_ends(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("obs_date").alias("y"), F.month("obs_date").alias("m")).agg(F.max("obs_date").alias("obs_date")).select("obs_date")


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Month ends; a ticker is eligible if it was quoted in the last five rows."""
    p = panel(spark, sf)
    recent = p.withColumn("value", F.when(F.count("value").over(Window.partitionBy("ticker").orderBy("obs_date").rowsBetween(-4, 0)) > 0, 1.0))
    return recent.join(month_ends(p), "obs_date", "left_semi")


BASE = """
px AS (
  SELECT upper(p_brand) AS ticker, CAST(l_shipdate AS DATE) AS obs_date, round(avg(p_retailprice) + 3e-8, 6) AS close,
         min(p_retailprice) AS low, max(p_retailprice) AS high, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE dayofweek(CAST(l_shipdate AS DATE)) NOT IN (0, 6) GROUP BY 1, 2
), days AS (SELECT DISTINCT obs_date FROM px), names AS (SELECT DISTINCT ticker FROM px
), g AS (SELECT obs_date, ticker, px.close AS value, px.volume FROM days CROSS JOIN names LEFT JOIN px USING (obs_date, ticker)
), f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS fv FROM g
), pub AS (SELECT * FROM g WHERE value IS NOT NULL
), div AS (SELECT obs_date, ticker, round(0.005 * close, 6) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, year(obs_date), quarter(obs_date) ORDER BY obs_date) AS n FROM px) WHERE n = 1
), mkt AS (SELECT obs_date, round(avg(close) + 3e-8, 6) AS value FROM px GROUP BY 1
), me AS (SELECT max(obs_date) AS obs_date FROM days GROUP BY year(obs_date), month(obs_date)
), el AS (SELECT obs_date, ticker, CASE WHEN n > 0 THEN 1.0::DOUBLE END AS value FROM (
    SELECT *, count(value) OVER (PARTITION BY ticker ORDER BY obs_date ROWS 4 PRECEDING) AS n FROM g) WHERE obs_date IN (SELECT obs_date FROM me)
)"""
WT = "OVER (PARTITION BY ticker ORDER BY obs_date"


def _sql(body: str, *more: str) -> str:
    return f"WITH {BASE}{''.join(', ' + m for m in more)} {body}"


def _r(x: str, name: str = "value") -> str:
    return f"round({x} + 3e-8, 6) AS {name}"


def _guard(agg: str, counted: str, n: int, part: str = WT) -> str:
    over = f"{part} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({counted}) {over} >= {n} THEN {agg} {over} END"


def _stale(metric: str, source: str, name: str, most: int = 5) -> str:
    """A metric over published rows, carried along the calendar and masked: CTEs ``name``."""
    return f"""{name} AS (SELECT obs_date, ticker, CASE WHEN count(value) {WT} ROWS {most} PRECEDING) > 0 THEN last_value(m IGNORE NULLS) {WT} ROWS UNBOUNDED PRECEDING) END AS value
  FROM (SELECT g.obs_date, g.ticker, g.value, x.m FROM g LEFT JOIN (SELECT obs_date, ticker, {metric} AS m FROM {source}) x USING (obs_date, ticker)))"""


RET = f"ret AS (SELECT obs_date, ticker, value, value / lag(value) {WT}) - 1 AS r FROM pub)"


def _vol(n: int) -> str:
    return f"({_guard('stddev_samp(r)', 'r', n)}) * sqrt(252.0)"


VOL60 = (RET, _stale(_vol(60), "ret", "v60"))
AVG = lambda n, name: _stale(_guard("avg(value)", "value", n), "pub", name)
ON_ME = "on_me AS (SELECT me.obs_date, names.ticker, (SELECT max(d.obs_date) FROM days d WHERE d.obs_date <= me.obs_date) AS at FROM me CROSS JOIN names)"

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


@register("scan_close_dense", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM g"))
def _(s, d):
    return rounded(panel(s, d))


@register("fill_forward", _sql(f"SELECT obs_date, ticker, {_r('fv')} FROM f"))
def _(s, d):
    return rounded(clean.ffill(panel(s, d)))


@register("fill_backward", _sql(f"SELECT obs_date, ticker, {_r(f'first_value(value IGNORE NULLS) {WT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} FROM g"))
def _(s, d):
    return rounded(clean.bfill(panel(s, d)))


@register("drop_incomplete_dates", _sql(f"SELECT obs_date, ticker, {_r('fv')} FROM f WHERE obs_date NOT IN (SELECT obs_date FROM f WHERE fv IS NULL) UNION ALL SELECT obs_date, ticker, {_r('value')} FROM g WHERE obs_date NOT IN (SELECT obs_date FROM g WHERE value IS NULL)"))
def _(s, d):
    """Filled forward, a date is complete once every ticker has begun; before that, hardly any is."""
    return rounded(clean.drop_incomplete_dates(clean.ffill(panel(s, d))).unionByName(clean.drop_incomplete_dates(panel(s, d))))


@register("pct_change_padded", _sql(f"SELECT obs_date, ticker, {_r(f'fv / lag(fv, 5) {WT}) - 1')} FROM f"))
def _(s, d):
    return rounded(rolling.pct_change_pad(panel(s, d), 5))


@register("pct_change_raw", _sql(f"SELECT obs_date, ticker, {_r(f'value / lag(value, 5) {WT}) - 1')} FROM g"))
def _(s, d):
    return rounded(rolling.pct_change_raw(panel(s, d), 5))


@register("holding_period_return", _sql(f"SELECT obs_date, ticker, {_r(f'lag(fv, 5) {WT}) / lag(fv, 20) {WT}) - 1')} FROM f"))
def _(s, d):
    return rounded(rolling.holding_period_return(panel(s, d), 20, 5))


@register("moving_average", _sql(f"SELECT obs_date, ticker, {_r(_guard('avg(value)', 'value', 10))} FROM g"))
def _(s, d):
    return rounded(rolling.simple_moving_average(panel(s, d), 10))


@register("moving_average_expanding", _sql(f"SELECT obs_date, ticker, {_r(f'avg(value) {WT} ROWS UNBOUNDED PRECEDING)')} FROM g"))
def _(s, d):
    return rounded(rolling.simple_moving_average(panel(s, d)))


@register("moving_average_published", _sql(f"SELECT obs_date, ticker, round(x.v + 3e-8, 6) AS value FROM g LEFT JOIN (SELECT obs_date, ticker, {_guard('avg(value)', 'value', 10)} AS v FROM pub) x USING (obs_date, ticker)"))
def _(s, d):
    return rounded(rolling.simple_moving_average(panel(s, d), 10, skip_nan=True))


@register("realized_volatility_published", _sql(f"SELECT obs_date, ticker, round(x.v + 3e-8, 6) AS value FROM g LEFT JOIN (SELECT obs_date, ticker, {_vol(20)} AS v FROM ret) x USING (obs_date, ticker)", RET))
def _(s, d):
    return rounded(rolling.realized_volatility(panel(s, d), 1, 20, skip_nan=True))


@register("volatility_multi_lag", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM vv", RET, _stale(f"CASE WHEN ({_vol(20)}) IS NOT NULL AND ({_vol(60)}) IS NOT NULL THEN greatest({_vol(20)}, {_vol(60)}) END", "ret", "vv")))
def _(s, d):
    return rounded(rolling.volatility(prices=panel(s, d), lags=[20, 60]))


@register("rolling_average_stale_masked", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM a20", AVG(20, "a20")))
def _(s, d):
    return rounded(rolling.rolling_average(panel(s, d), 20))


@register("relative_sma", _sql(f"SELECT obs_date, ticker, {_r('a20.value / f.fv')} FROM a20 JOIN f USING (obs_date, ticker)", AVG(20, "a20")))
def _(s, d):
    return rounded(rolling.relative_sma(panel(s, d), 20))


_BETA = f"bt AS (SELECT obs_date, ticker, r, m / lag(m) {WT}) - 1 AS b FROM (SELECT ret.*, mkt.value AS m FROM ret JOIN mkt USING (obs_date)))"
_BETA60 = _stale(f"({_guard('covar_samp(r, b)', 'r + b', 60)}) / ({_guard('var_samp(CASE WHEN r + b IS NOT NULL THEN b END)', 'r + b', 60)})", "bt", "b60")


@register("beta_against_market", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM b60", RET, _BETA, _BETA60))
def _(s, d):
    return rounded(rolling.beta(prices=panel(s, d), benchmark=market(s, d), lags=60))


@register("realized_beta_against_ticker", _sql(
    f"SELECT g.obs_date, g.ticker, round(z.v + 3e-8, 6) AS value FROM g LEFT JOIN (SELECT obs_date, ticker, ({_guard('covar_samp(x, y)', 'x + y', 30)}) / ({_guard('var_samp(CASE WHEN x + y IS NOT NULL THEN y END)', 'x + y', 30)}) AS v FROM rr) z USING (obs_date, ticker)",
    "one AS (SELECT obs_date, value AS b FROM g WHERE ticker = (SELECT min(ticker) FROM g))",
    f"rr AS (SELECT obs_date, ticker, value / lag(value) {WT}) - 1 AS x, b / lag(b) {WT}) - 1 AS y FROM pub JOIN one USING (obs_date) WHERE b IS NOT NULL)",
))
def _(s, d):
    p = panel(s, d)
    return rounded(rolling.realized_beta(p, p.agg(F.min("ticker")).first()[0], 1, 30, skip_nan=True))


@register("rolling_drawdown", _sql(f"SELECT obs_date, ticker, {_r(f'fv / max(fv) {WT} ROWS 59 PRECEDING) - 1')} FROM f"))
def _(s, d):
    return rounded(rolling.rolling_drawdown(panel(s, d), 60))


@register("maximum_drawdown", _sql(f"SELECT ticker, {_r('min(v)')} FROM (SELECT ticker, fv / max(fv) {WT} ROWS UNBOUNDED PRECEDING) - 1 AS v FROM f) GROUP BY ticker"))
def _(s, d):
    return rounded(rolling.maximum_drawdown(panel(s, d)))


@register("exponentially_weighted_return", _sql(f"SELECT obs_date, ticker, {_r(f'(fv / lag(fv) {WT}) - 1) * exp(-2.0 / count(*) OVER (PARTITION BY ticker) * row_number() OVER (PARTITION BY ticker ORDER BY obs_date DESC))')} FROM f"))
def _(s, d):
    return rounded(rolling.exponentially_weighted_return(panel(s, d), 2.0))


@register("returns_to_prices", _sql(
    f"SELECT obs_date, ticker, {_r(f'CASE WHEN nr IS NOT NULL OR nd IS NULL THEN coalesce(product(1 + r) {WT} ROWS UNBOUNDED PRECEDING), 1.0) END')} FROM (SELECT *, lead(r) {WT}) AS nr, lead(obs_date) {WT}) AS nd FROM fr)",
    f"fr AS (SELECT obs_date, ticker, fv / lag(fv) {WT}) - 1 AS r FROM f)",
))
def _(s, d):
    return rounded(rolling.returns_to_prices(rolling.pct_change_pad(panel(s, d))))


@register("winsorize_dates", _sql(f"SELECT obs_date, ticker, {_r('CASE WHEN value BETWEEN lo AND hi THEN value END')} FROM (SELECT *, quantile_cont(value, 0.1) OVER (PARTITION BY obs_date) AS lo, quantile_cont(value, 0.9) OVER (PARTITION BY obs_date) AS hi FROM g)"))
def _(s, d):
    return rounded(cross.winsorize(panel(s, d), 0.1, 0.9))


_RANK = "CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY obs_date ORDER BY value {} NULLS LAST, ticker) END"


@register("rank_filter_number", _sql(f"SELECT obs_date, ticker, CASE WHEN k <= 3 THEN 1.0::DOUBLE END AS value FROM (SELECT *, {_RANK.format('DESC')} AS k FROM g)"))
def _(s, d):
    return cross.rank_filter(panel(s, d), False, True, 3)


@register("rank_filter_fraction", _sql(f"SELECT obs_date, ticker, CASE WHEN k > round_even(0.5 * n, 0) THEN 1.0::DOUBLE END AS value FROM (SELECT *, {_RANK.format('ASC')} AS k, count(value) OVER (PARTITION BY obs_date) AS n FROM g)"))
def _(s, d):
    return cross.rank_filter(panel(s, d), True, False, 0.5)


_TOP = f"hp AS (SELECT obs_date, ticker, fv / lag(fv, 20) {WT}) - 1 AS v FROM f), rk AS (SELECT el.obs_date, el.ticker, v * el.value AS value FROM el LEFT JOIN hp USING (obs_date, ticker))"


@register("top_k_signal", _sql(f"SELECT obs_date, ticker, CASE WHEN k <= 5 THEN 1.0::DOUBLE END AS value FROM (SELECT *, {_RANK.format('DESC')} AS k FROM rk)", _TOP))
def _(s, d):
    return cross.top_k(rolling.holding_period_return(panel(s, d), 20), eligible(s, d), number=5)


@register("top_k_signal_winsorized", _sql(
    "SELECT obs_date, ticker, CASE WHEN j <= round_even(0.4 * n2, 0) THEN 1.0::DOUBLE END AS value FROM (SELECT *, count(k2) OVER (PARTITION BY obs_date) AS n2, CASE WHEN k2 IS NOT NULL THEN row_number() OVER (PARTITION BY obs_date ORDER BY k2 NULLS LAST, ticker) END AS j FROM "
    f"(SELECT *, CASE WHEN k > 2 THEN k END AS k2 FROM (SELECT *, {_RANK.format('ASC')} AS k FROM rk)))",
    _TOP,
))
def _(s, d):
    return cross.top_k(rolling.holding_period_return(panel(s, d), 20), eligible(s, d), fraction=0.4, ascending=True, drop_best_number=2)


@register("frequency_weekday", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM g WHERE isodow(obs_date) = 3"))
def _(s, d):
    return rounded(cross.frequency_filter(panel(s, d), "wednesday"))


@register("frequency_every_nth", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM g JOIN (SELECT obs_date, row_number() OVER (ORDER BY obs_date DESC) - 1 AS k FROM days) USING (obs_date) WHERE k % 5 = 0"))
def _(s, d):
    return rounded(cross.frequency_filter(panel(s, d), 5))


_ENDS = "(SELECT DISTINCT last_day(obs_date) AS obs_date FROM days)"


@register("as_of_on_calendar", _sql(f"SELECT c.obs_date, names.ticker, {_r('g.value')} FROM (SELECT c.obs_date, max(days.obs_date) AS at FROM {_ENDS} c JOIN days ON days.obs_date <= c.obs_date GROUP BY 1) c CROSS JOIN names LEFT JOIN g ON g.obs_date = c.at AND g.ticker = names.ticker"))
def _(s, d):
    p = panel(s, d)
    return rounded(asof.on_calendar(p, p.select(F.last_day("obs_date").alias("obs_date")).distinct()))


@register("as_of_per_ticker", _sql(f"SELECT px.obs_date, px.ticker, {_r('px.close', 'close')}, {_r('div.value', 'as_of_value')} FROM px ASOF LEFT JOIN div ON px.ticker = div.ticker AND px.obs_date >= div.obs_date"))
def _(s, d):
    return rounded(asof.per_ticker(quotes(s, d).select("obs_date", "ticker", "close"), dividends(s, d)), "close", "as_of_value")


@register("as_of_merge", _sql(f"SELECT m.obs_date, {_r('m.value', 'value_x')}, {_r('o.value')} FROM mkt m ASOF LEFT JOIN (SELECT obs_date, value FROM mkt WHERE day(obs_date) <= 7 AND isodow(obs_date) = 1) o ON m.obs_date >= o.obs_date"))
def _(s, d):
    m = market(s, d)
    return rounded(asof.merge_as_of(m, m.where("dayofmonth(obs_date) <= 7 and weekday(obs_date) = 0")), "value_x", "value")


@register("trailing_slices", _sql(f"SELECT slice_date, ticker, count(value) AS n, {_r('avg(value)')} FROM (SELECT a.obs_date AS slice_date, g.ticker, g.value FROM no a JOIN me ON me.obs_date = a.obs_date JOIN no b ON b.k BETWEEN a.k - 19 AND a.k JOIN g ON g.obs_date = b.obs_date) GROUP BY 1, 2", "no AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS k FROM days)"))
def _(s, d):
    p = panel(s, d)
    return rounded(asof.trailing_slices(p, month_ends(p), 20).groupBy("slice_date", "ticker").agg(F.count("value").alias("n"), F.avg("value").alias("value")))


@register("aggregate_panels", _sql(f"SELECT obs_date, ticker, {_r('(value + volume) / 2')} FROM g"))
def _(s, d):
    return rounded(cross.aggregate([panel(s, d), panel(s, d, "volume")], "avg"))


@register("combine_signals", _sql(
    "SELECT a.obs_date, a.ticker, CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE greatest(a.s, b.s) END AS \"union\", a.s * b.s AS intersection FROM (SELECT obs_date, ticker, sign(value - 950)::DOUBLE AS s FROM g) a JOIN (SELECT obs_date, ticker, sign(volume - 60)::DOUBLE AS s FROM g) b USING (obs_date, ticker)"
))
def _(s, d):
    a = panel(s, d).withColumn("value", F.signum(F.col("value") - 950))
    b = panel(s, d, "volume").withColumn("value", F.signum(F.col("value") - 60))
    u, i = cross.combine_signals([a, b], "union"), cross.combine_signals([a, b], "intersection")
    return u.withColumnRenamed("value", "union").join(i.withColumnRenamed("value", "intersection"), ["obs_date", "ticker"])


@register("pairwise_correlation", _sql(f"SELECT a.ticker AS ticker_1, b.ticker AS ticker_2, {_r('corr(a.value, b.value)')} FROM pub a JOIN pub b USING (obs_date) GROUP BY 1, 2"))
def _(s, d):
    return rounded(cross.pairwise_correlation(panel(s, d)))


@register("covariance_per_year", _sql(f"SELECT y, a.ticker AS ticker_1, b.ticker AS ticker_2, {_r('CASE WHEN count(a.fv + b.fv) = count(*) THEN covar_samp(a.fv, b.fv) END')} FROM (SELECT *, year(obs_date) AS y FROM f) a JOIN f b USING (obs_date) GROUP BY 1, 2, 3"))
def _(s, d):
    return rounded(cross.covariance(clean.ffill(panel(s, d)).withColumn("y", F.year("obs_date").cast("long")), ["y"]))


@register("describe", _sql(f"SELECT ticker, count(value) AS n, {_r('avg(value)', 'mean')}, {_r('stddev_samp(value)', 'std')}, min(value) AS least, {_r('quantile_cont(value, 0.25)', 'q25')}, {_r('quantile_cont(value, 0.5)', 'q50')}, {_r('quantile_cont(value, 0.75)', 'q75')}, max(value) AS greatest FROM g GROUP BY ticker"))
def _(s, d):
    return rounded(cross.describe(panel(s, d)), "mean", "std", "q25", "q50", "q75")


_TR = (
    "tp AS (SELECT f.obs_date, f.ticker, f.value, fv, div.value AS dv FROM f LEFT JOIN div USING (obs_date, ticker))",
    f"tg AS (SELECT *, 1 + coalesce(fv / lag(fv) {WT}) - 1, 0) + coalesce(dv / lag(fv) {WT}) * 0.85, 0) AS gr, first_value(value IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p0 FROM tp)",
)


@register("total_return", _sql(f"SELECT obs_date, ticker, {_r(f'CASE WHEN value IS NOT NULL THEN product(gr) {WT} ROWS UNBOUNDED PRECEDING) * p0 END')} FROM tg", *_TR))
def _(s, d):
    return rounded(store.total_return(panel(s, d), dividends(s, d), 0.15))


@register("currency_conversion", _sql(
    f"SELECT g.obs_date, g.ticker, {_r('g.value * CASE WHEN g.ccy = 2 THEN 1.0 ELSE r.value END')} FROM (SELECT *, CAST(right(ticker, 1) AS INT) % 5 AS ccy FROM g) g ASOF LEFT JOIN fx r ON g.ccy = r.ccy AND g.obs_date >= r.obs_date",
    "fx AS (SELECT CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS ccy, CAST(o_orderdate AS DATE) AS obs_date, round(1 + avg(c_acctbal) / 100000 + 3e-8, 6) AS value "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)",
))
def _(s, d):
    return rounded(store.convert(panel(s, d), instruments(s, d), fx(s, d), "ASIA"))


def _universe(s, d):
    p = panel(s, d)
    return p, strategy.Universe([r[0] for r in p.select("ticker").distinct().collect()], month_ends(p))


@register("universe_liquidity", _sql("SELECT obs_date, ticker, CASE WHEN a.value > 30 THEN 1.0::DOUBLE END AS value FROM a JOIN me USING (obs_date)", "lq AS (SELECT obs_date, ticker, volume AS value FROM g WHERE volume IS NOT NULL)", _stale(_guard("avg(value)", "value", 10), "lq", "a")))
def _(s, d):
    return _universe(s, d)[1].liquidity(panel(s, d, "volume"), 10, 30).eligibility()


@register("universe_price_history", _sql(f"SELECT obs_date, ticker, CASE WHEN n >= 12 THEN 1.0::DOUBLE END AS value FROM (SELECT *, count(value) {WT} ROWS 19 PRECEDING) AS n FROM g) JOIN me USING (obs_date)"))
def _(s, d):
    p, u = _universe(s, d)
    return u.price_history(p, 20, 0.6).eligibility()


@register("universe_published", _sql(f"SELECT obs_date, ticker, CASE WHEN n > 0 AND m = 3 THEN 1.0::DOUBLE END AS value FROM (SELECT *, max(n) {WT} ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, count(value) {WT} ROWS 2 PRECEDING) AS n FROM g)) JOIN me USING (obs_date)"))
def _(s, d):
    p, u = _universe(s, d)
    return u.published(p, 3).eligibility()


@register("sma_cross_signal", _sql("SELECT obs_date, ticker, el.value * CASE WHEN a5.value < a20.value THEN -1 ELSE 1 END AS value FROM el JOIN a5 USING (obs_date, ticker) JOIN a20 USING (obs_date, ticker)", AVG(5, "a5"), AVG(20, "a20")))
def _(s, d):
    return strategy.SmaCross(eligible(s, d), panel(s, d), 20, 5).compute()


@register("volatility_rank_signal", _sql(f"SELECT obs_date, ticker, CASE WHEN k <= 5 THEN 1.0::DOUBLE END AS value FROM (SELECT *, {_RANK.format('ASC')} AS k FROM (SELECT el.obs_date, el.ticker, round(v60.value, 9) * el.value AS value FROM el JOIN v60 USING (obs_date, ticker)))", *VOL60))
def _(s, d):
    vol = rolling.volatility(prices=panel(s, d), lags=60).withColumn("value", F.round("value", 9))
    return strategy.RankSignal(eligible(s, d), vol, True, number=5).compute()


_PERF = f"pf AS (SELECT obs_date, ticker, (fv / lag(fv, 20) {WT}) - 1 + fv / lag(fv, 60) {WT}) - 1) / 2 AS v FROM f)"


@register("performance_rank_signal", _sql(f"SELECT obs_date, ticker, CASE WHEN k <= round_even(0.3 * n, 0) THEN 1.0::DOUBLE END AS value FROM (SELECT *, {_RANK.format('DESC')} AS k, count(value) OVER (PARTITION BY obs_date) AS n FROM (SELECT el.obs_date, el.ticker, v * el.value AS value FROM el JOIN pf USING (obs_date, ticker)))", _PERF))
def _(s, d):
    return strategy.performance_rank(eligible(s, d), panel(s, d), [20, 60], fraction=0.3).compute()


_SIG = "sg AS (SELECT obs_date, ticker, el.value * CASE WHEN a5.value < a20.value THEN -1 ELSE 1 END AS value FROM el JOIN a5 USING (obs_date, ticker) JOIN a20 USING (obs_date, ticker))"


def _signal(s, d):
    return strategy.SmaCross(eligible(s, d), panel(s, d), 20, 5).compute()


@register("equal_weight", _sql(f"SELECT obs_date, ticker, {_r('coalesce(value / nullif(count(value) OVER (PARTITION BY obs_date), 0), 0)')} FROM sg", AVG(5, "a5"), AVG(20, "a20"), _SIG))
def _(s, d):
    return rounded(strategy.equal_weight(_signal(s, d)))


@register("equal_weight_net_zero", _sql(f"SELECT obs_date, ticker, {_r('coalesce(value / count(*) FILTER (value = sv) OVER (PARTITION BY obs_date, sv), 0)')} FROM (SELECT *, sign(value) AS sv FROM sg)", AVG(5, "a5"), AVG(20, "a20"), _SIG))
def _(s, d):
    return rounded(strategy.equal_weight(_signal(s, d), net_zero=True))


@register("inverse_volatility_weight", _sql(f"SELECT obs_date, ticker, {_r('coalesce(x / sum(x) OVER (PARTITION BY obs_date) * value, 0)')} FROM (SELECT el.obs_date, el.ticker, el.value, CASE WHEN el.value IS NOT NULL THEN 1 / v60.value END AS x FROM el JOIN v60 USING (obs_date, ticker))", *VOL60))
def _(s, d):
    return rounded(strategy.volatility_weight(eligible(s, d), panel(s, d)))


@register("static_weight", _sql("SELECT obs_date, ticker, CASE WHEN value = 1 AND ticker = t THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM el CROSS JOIN (SELECT min(ticker) AS t FROM names)"))
def _(s, d):
    import warnings

    e = eligible(s, d)
    table = e.agg(F.min("ticker").alias("ticker")).select("ticker", F.lit(1).alias("signal"), F.lit(100.0).alias("weight"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return strategy.static_weight(e, table)


_EW = ("ew AS (SELECT obs_date, ticker, coalesce(value / nullif(count(value) OVER (PARTITION BY obs_date), 0), 0) AS value FROM el)", "fd AS (SELECT min(obs_date) AS d0 FROM me)")
_DW = (
    *_EW,
    "dm AS (SELECT days.obs_date, max(me.obs_date) AS at FROM days JOIN me ON me.obs_date <= days.obs_date GROUP BY 1)",
    f"bw AS (SELECT f.obs_date, f.ticker, f.fv / lag(f.fv) {WT.replace('ticker ORDER BY obs_date', 'f.ticker ORDER BY f.obs_date')}) - 1 AS ret, ew.value AS weight FROM f JOIN dm USING (obs_date) JOIN ew ON ew.obs_date = dm.at AND ew.ticker = f.ticker)",
)


def _strategy(s, d, **how) -> strategy.Strategy:
    return strategy.Strategy(eligible(s, d), strategy.equal_weight, panel(s, d), **how)


def _index(lag: int, tc: float, fee: float, source: str) -> tuple[str, ...]:
    return (
        f"tm AS (SELECT obs_date, coalesce(ret, 0) * lag(weight, {lag}) {WT}) AS t, abs(weight - lag(weight) {WT})) AS c FROM {source})",
        f"dy AS (SELECT obs_date, CASE WHEN count(t) = count(*) THEN sum(t) END - {tc} * coalesce(sum(c), 0) AS r0 FROM tm GROUP BY 1)",
        f"dr AS (SELECT obs_date, r0 - {fee} * date_diff('day', lag(obs_date) OVER (ORDER BY obs_date), obs_date) / 365.0 AS r FROM dy)" if tc or fee else "dr AS (SELECT obs_date, r0 AS r FROM dy)",
        "lv AS (SELECT obs_date, CASE WHEN r IS NOT NULL THEN 100 * product(1 + r) OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING) WHEN lead(r) OVER (ORDER BY obs_date) IS NOT NULL AND count(r) OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING) = 0 THEN 100 END AS value FROM dr)",
    )


@register("back_test_gross", _sql(f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", *_DW, *_index(2, 0, 0, "bw")))
def back_test_gross(s, d):
    return rounded(_strategy(s, d).back_test())


@register("back_test_net", _sql(f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", *_DW, *_index(1, 0.001, 0.01, "bw")))
def _(s, d):
    return rounded(_strategy(s, d, weight_lag=1, transaction_cost=0.001, fee=0.01).back_test())


_VT = (
    f"st AS (SELECT obs_date, sum(t) AS value FROM (SELECT obs_date, ret * lag(weight, 2) {WT}) AS t FROM bw) GROUP BY 1)",
    f"sv AS (SELECT obs_date, CASE WHEN count(value) OVER (ORDER BY obs_date ROWS 5 PRECEDING) > 0 THEN last_value(m IGNORE NULLS) OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING) END AS v FROM (SELECT st.*, m FROM st LEFT JOIN (SELECT obs_date, {_guard('stddev_samp(value)', 'value', 60, 'OVER (ORDER BY obs_date')} * sqrt(252.0) AS m FROM st WHERE value IS NOT NULL) USING (obs_date)))",
    "sk AS (SELECT obs_date, lag(CASE WHEN v > 0 THEN least(greatest(0.05 / v, 0), 1) END) OVER (ORDER BY obs_date) AS k FROM sv)",
    "vw AS (SELECT bw.obs_date, bw.ticker, ret, weight * k AS weight FROM bw JOIN sk USING (obs_date))",
)


@register("volatility_target", _sql(f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", *_DW, *_VT, *_index(2, 0, 0, "vw")))
def _(s, d):
    return rounded(_strategy(s, d, overlays=strategy.VolatilityTarget(0.05)).back_test())


_HEDGE = (
    f"hr AS (SELECT obs_date, ticker, ret AS r, m / lag(m) {WT}) - 1 AS b FROM (SELECT bw.*, mkt.value AS m FROM bw JOIN mkt USING (obs_date)) WHERE ret IS NOT NULL)",
    f"hb AS (SELECT obs_date, ticker, CASE WHEN count(ret) {WT} ROWS 5 PRECEDING) > 0 THEN last_value(x IGNORE NULLS) {WT} ROWS UNBOUNDED PRECEDING) END AS beta FROM (SELECT bw.obs_date, bw.ticker, bw.ret, x FROM bw LEFT JOIN (SELECT obs_date, ticker, ({_guard('covar_samp(r, b)', 'r + b', 60)}) / ({_guard('var_samp(CASE WHEN r + b IS NOT NULL THEN b END)', 'r + b', 60)}) AS x FROM hr) USING (obs_date, ticker)))",
    "hs AS (SELECT obs_date, CASE WHEN count(beta * weight) = count(*) THEN sum(beta * weight) END AS sb FROM hb JOIN bw USING (obs_date, ticker) GROUP BY 1)",
    "hh AS (SELECT obs_date, lag(CASE WHEN sb IS NOT NULL THEN -least(greatest(sb, 0), 999) END) OVER (ORDER BY obs_date) AS weight FROM hs)",
    # no position, no weights: the whole date goes, whichever instrument lacks its beta
    "hm AS (SELECT obs_date, value / lag(value) OVER (ORDER BY obs_date) - 1 AS ret FROM mkt WHERE obs_date >= (SELECT min(obs_date) FROM bw))",
    "hw AS (SELECT bw.obs_date, bw.ticker, bw.ret, CASE WHEN hh.weight IS NOT NULL THEN bw.weight END AS weight FROM bw JOIN hh USING (obs_date) UNION ALL SELECT obs_date, 'HEDGE', hm.ret, hh.weight FROM hm JOIN hh USING (obs_date))",
)


@register("beta_hedge", _sql(f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", *_DW, *_HEDGE, *_index(2, 0, 0, "hw")))
def _(s, d):
    return rounded(_strategy(s, d, overlays=[strategy.BetaHedge(market(s, d), lags=60)]).back_test())


@register("index_drifting", _sql(
    f"SELECT obs_date, rebalance, {_r('100 * coalesce(product(CASE WHEN rebalance = 1 THEN fac END) OVER (ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * fac')} FROM fx2",
    *_EW,
    "dm AS (SELECT days.obs_date, max(me.obs_date) AS since FROM days JOIN me ON me.obs_date <= days.obs_date GROUP BY 1)",
    "rb AS (SELECT obs_date, since, CASE WHEN since = lag(since) OVER (ORDER BY obs_date) THEN 0 ELSE 1 END AS rebalance FROM dm)",
    "wp AS (SELECT f.obs_date, f.ticker, fv AS p, rebalance, ew.value AS w FROM f JOIN rb USING (obs_date) JOIN ew ON ew.obs_date = rb.since AND ew.ticker = f.ticker)",
    f"gp AS (SELECT obs_date, rebalance, lag(w) {WT}) * (p / last_value(CASE WHEN rebalance = 1 THEN p END IGNORE NULLS) {WT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) AS gr, abs(w - lag(w) {WT})) AS c FROM wp)",
    "dg AS (SELECT obs_date, max(rebalance) AS rebalance, coalesce(sum(gr), 0) AS gr, coalesce(sum(c), 0) AS c FROM gp GROUP BY 1)",
    "fx2 AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY obs_date) = 1 THEN 1.0 ELSE 1 + gr - 0.01 * date_diff('day', last_value(CASE WHEN rebalance = 1 THEN obs_date END IGNORE NULLS) OVER (ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), obs_date) / 360.0 - 0.001 * c END AS fac FROM dg)",
))
def _(s, d):
    p = panel(s, d)
    return rounded(strategy.index_drifting(p, strategy.equal_weight(eligible(s, d)), 0.001, 0.01))


@register("monthly_returns", _sql(
    f"SELECT ticker, y AS year, m AS month, {_r('e / coalesce(lag(e) OVER (PARTITION BY ticker ORDER BY y, m), s) - 1')} FROM (SELECT ticker, year(obs_date)::INT AS y, month(obs_date)::INT AS m, arg_max(value, obs_date) AS e, arg_min(value, obs_date) AS s FROM pub GROUP BY 1, 2, 3)"
))
def _(s, d):
    return rounded(report.monthly_returns(panel(s, d)))


@register("risk_and_return", _sql(
    f"SELECT ticker, {_r('avg(ar)', 'mean_return')}, {_r('avg(av)', 'mean_volatility')}, {_r('min(dd)', 'maximum_drawdown')}, {_r('avg(ar) / avg(av)', 'sharpe')} FROM (SELECT ticker, fv / lag(fv, 252) {WT}) - 1 AS ar, {_guard('stddev_samp(r)', 'r', 252)} * sqrt(252.0) AS av, fv / max(fv) {WT} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT *, fv / lag(fv) {WT}) - 1 AS r FROM f WHERE obs_date NOT IN (SELECT obs_date FROM f WHERE fv IS NULL)) q) GROUP BY ticker"
))
def _(s, d):
    return rounded(report.risk_and_return(clean.ffill(panel(s, d)))["Risk and return"], "mean_return", "mean_volatility", "maximum_drawdown", "sharpe")


@register("html_links", """
SELECT page_id, z[1] AS ticker, z[2] AS name FROM (
  SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="/([^"]*)"[^>]*>([^<]*)</a>', 1), regexp_extract_all(html, '<a href="/([^"]*)"[^>]*>([^<]*)</a>', 2))) AS z FROM pages)
""")
def _(s, d):
    return readers.html_links(_table(s, d, "pages"))


@register("membership_panel", _sql(
    "SELECT me.obs_date, t.ticker, CASE WHEN mb.ticker IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM me CROSS JOIN (SELECT DISTINCT ticker FROM mb) t LEFT JOIN mb ON mb.obs_date = me.obs_date AND mb.ticker = t.ticker WHERE me.obs_date >= (SELECT min(obs_date) FROM mb)",
    "mb AS (SELECT obs_date, ticker FROM pub WHERE obs_date IN (SELECT obs_date FROM me) AND volume > 40)",
))
def _(s, d):
    q = quotes(s, d)
    return readers.membership_panel(q.where("volume > 40"), month_ends(q))


@register("null_before_cutoff", _sql(f"SELECT obs_date, ticker, {_r('CASE WHEN obs_date > c THEN value END')} FROM g JOIN (SELECT ticker, min(obs_date) + 30 AS c FROM div GROUP BY 1) USING (ticker)"))
def _(s, d):
    cut = dividends(s, d).groupBy("ticker").agg(F.date_add(F.min("obs_date"), 30).alias("cutoff"))
    return rounded(clean.null_before(panel(s, d), cut))


@register("wide_to_long", _sql(f"SELECT obs_date, ticker, {_r('value')} FROM pub"))
def _(s, d):
    p = panel(s, d)
    return rounded(clean.long(clean.wide(p, [r[0] for r in p.select("ticker").distinct().orderBy("ticker").collect()])))


@register("clip", _sql(f"SELECT obs_date, ticker, {_r('CASE WHEN value IS NOT NULL THEN least(greatest(value, 945.0), 955.0) END')} FROM g"))
def _(s, d):
    return rounded(clean.clip(panel(s, d), 945, 955))


@register("business_day_shift", _sql(
    "SELECT obs_date, (SELECT max(d) FROM (SELECT CAST(range AS DATE) AS d FROM range(x.obs_date - INTERVAL 7 DAY, x.obs_date, INTERVAL 1 DAY)) WHERE isodow(d) <= 5) AS before, (SELECT min(d) FROM (SELECT CAST(range AS DATE) AS d FROM range(x.obs_date + INTERVAL 1 DAY, x.obs_date + INTERVAL 7 DAY, INTERVAL 1 DAY)) WHERE isodow(d) <= 5) AS after FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS obs_date FROM orders) x"
))
def _(s, d):
    days = _table(s, d, "orders").select(F.to_date("o_orderdate").alias("obs_date")).distinct()
    return days.select("obs_date", calendar.business_shift(F.col("obs_date"), -1).alias("before"), calendar.business_shift(F.col("obs_date"), 1).alias("after"))


@register("ticker_translation", "SELECT DISTINCT upper(p_brand) || ' EQUITY' AS terminal, CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE '' END || 'SEK=X' AS quote FROM part")
def _(s, d):
    p = _table(s, d, "part")
    base = F.when(F.col("p_size") % 2 == 0, "EUR").otherwise("USD")
    return p.select(text.add_suffix(F.col("p_brand")).alias("terminal"), text.fx_to_quote(text.fx_ticker(F.lit("SEK"), base)).alias("quote")).distinct()


# two assets, whose optima have closed forms

_TWO = (
    "two AS (SELECT obs_date, CASE WHEN CAST(right(ticker, 1) AS INT) % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS ticker, avg(close) AS value FROM px GROUP BY 1, 2)",
    "tf AS (SELECT d.obs_date, t.ticker, last_value(value IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.obs_date ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT DISTINCT obs_date FROM two) d CROSS JOIN (VALUES ('EVEN'), ('ODD')) t(ticker) LEFT JOIN two ON two.obs_date = d.obs_date AND two.ticker = t.ticker)",
    f"tr AS (SELECT obs_date, ticker, coalesce(v / lag(v) {WT}) - 1, 0) AS r FROM tf)",
    "tw AS (SELECT e.obs_date, row_number() OVER (ORDER BY e.obs_date) AS n, e.r AS x, o.r AS y FROM tr e JOIN tr o USING (obs_date) WHERE e.ticker = 'EVEN' AND o.ticker = 'ODD')",
    "tc AS (SELECT obs_date, var_samp(x) OVER w AS xx, var_samp(y) OVER w AS yy, covar_samp(x, y) OVER w AS xy FROM tw WINDOW w AS (ORDER BY obs_date ROWS 59 PRECEDING))",
)


def two(s, d) -> DataFrame:
    q = quotes(s, d).withColumn("ticker", F.when(F.substring("ticker", -1, 1).cast("int") % 2 == 0, "EVEN").otherwise("ODD"))
    return dense(q.groupBy("obs_date", "ticker").agg(F.avg("close").alias("value")))


def _both(s, d) -> DataFrame:
    """Both eligible at month ends, from the third on."""
    p = two(s, d)
    ends = month_ends(p).withColumn("n", F.row_number().over(Window.orderBy("obs_date"))).where("n > 3").select("obs_date")
    return p.join(ends, "obs_date", "left_semi").withColumn("value", F.lit(1.0))


_ENDS3 = "e3 AS (SELECT obs_date FROM (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS n FROM me) WHERE n > 3)"
_LEAST = "(yy - xy) / (xx + yy - 2 * xy)"


def _shares(x: str) -> str:
    return f"SELECT obs_date, ticker, {_r('value', 'value').replace(', 6)', ', 4)')} FROM (SELECT obs_date, 'EVEN' AS ticker, {x} AS value FROM tc JOIN e3 USING (obs_date) UNION ALL SELECT obs_date, 'ODD', 1 - ({x}) FROM tc JOIN e3 USING (obs_date))"


def _four(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round(F.col("value") + SHIFT, 4))


@register("optimized_weight_two_bounded", _sql(_shares(f"least(greatest({_LEAST}, 0.45), 0.55)"), *_TWO, _ENDS3))
def _(s, d):
    return _four(strategy.optimized_weight(_both(s, d), two(s, d), 60, low=0.45, high=0.55))


@register("optimized_weight_two_analytic", _sql(_shares(_LEAST), *_TWO, _ENDS3))
def _(s, d):
    return _four(strategy.optimized_weight(_both(s, d), two(s, d), 60))


@register("optimized_weight_two_custom", _sql(_shares("sqrt(yy) / (sqrt(xx) + sqrt(yy))"), *_TWO, _ENDS3))
def _(s, d):
    """A user's own optimiser: weights in proportion to the reciprocal of volatility."""

    def reciprocal(returns, cov):
        import numpy as np

        w = 1 / np.sqrt(np.diag(cov))
        return w / w.sum()

    return _four(strategy.optimized_weight(_both(s, d), two(s, d), 60, kind=reciprocal))


# three assets: the least variance over the simplex lies inside it, on an edge or in a corner; the best that is feasible is it

_THREE = (
    "three AS (SELECT obs_date, CASE CAST(right(ticker, 1) AS INT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS ticker, avg(close) AS value FROM px GROUP BY 1, 2)",
    "hf AS (SELECT d.obs_date, t.ticker, last_value(value IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.obs_date ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT DISTINCT obs_date FROM three) d CROSS JOIN (VALUES ('A'), ('B'), ('C')) t(ticker) LEFT JOIN three ON three.obs_date = d.obs_date AND three.ticker = t.ticker)",
    f"hr3 AS (SELECT obs_date, ticker, coalesce(v / lag(v) {WT}) - 1, 0) AS r FROM hf)",
    "hx AS (SELECT a.obs_date, a.r AS x, b.r AS y, c.r AS z FROM hr3 a JOIN hr3 b USING (obs_date) JOIN hr3 c USING (obs_date) WHERE a.ticker = 'A' AND b.ticker = 'B' AND c.ticker = 'C')",
    "hc AS (SELECT obs_date, var_samp(x) OVER w AS xx, var_samp(y) OVER w AS yy, var_samp(z) OVER w AS zz, covar_samp(x, y) OVER w AS xy, covar_samp(x, z) OVER w AS xz, covar_samp(y, z) OVER w AS yz FROM hx WINDOW w AS (ORDER BY obs_date ROWS 59 PRECEDING))",
    # inside: z = 1 - x - y leaves two linear equations
    "hk AS (SELECT *, xx + zz - 2 * xz AS p, yy + zz - 2 * yz AS q, xy + zz - xz - yz AS s, zz - xz AS u, zz - yz AS t FROM hc JOIN e3 USING (obs_date))",
    "hw AS (SELECT obs_date, xx, yy, zz, xy, xz, yz, unnest([{'x': (u * q - t * s) / (p * q - s * s), 'y': (t * p - u * s) / (p * q - s * s)}, {'x': (yy - xy) / (xx + yy - 2 * xy), 'y': 1 - (yy - xy) / (xx + yy - 2 * xy)}, {'x': (zz - xz) / (xx + zz - 2 * xz), 'y': 0.0}, {'x': 0.0, 'y': (zz - yz) / (yy + zz - 2 * yz)}, {'x': 1.0, 'y': 0.0}, {'x': 0.0, 'y': 1.0}, {'x': 0.0, 'y': 0.0}]) AS c FROM hk)",
    "hb3 AS (SELECT obs_date, arg_min(c, c.x * c.x * xx + c.y * c.y * yy + (1 - c.x - c.y) ** 2 * zz + 2 * c.x * c.y * xy + 2 * c.x * (1 - c.x - c.y) * xz + 2 * c.y * (1 - c.x - c.y) * yz) AS c FROM hw WHERE c.x >= -1e-12 AND c.y >= -1e-12 AND c.x + c.y <= 1 + 1e-12 GROUP BY 1)",
)


def three(s, d) -> DataFrame:
    rest = F.substring("ticker", -1, 1).cast("int") % 3
    q = quotes(s, d).withColumn("ticker", F.when(rest == 0, "A").when(rest == 1, "B").otherwise("C"))
    return dense(q.groupBy("obs_date", "ticker").agg(F.avg("close").alias("value")))


@register("optimized_weight_three_bounded", _sql(
    "SELECT obs_date, ticker, round(value + 3e-8, 4) AS value FROM (SELECT obs_date, 'A' AS ticker, c.x AS value FROM hb3 UNION ALL SELECT obs_date, 'B', c.y FROM hb3 UNION ALL SELECT obs_date, 'C', 1 - c.x - c.y FROM hb3)", _ENDS3, *_THREE
))
def _(s, d):
    p = three(s, d)
    signal = p.join(_both(s, d).select("obs_date").distinct(), "obs_date", "left_semi").withColumn("value", F.lit(1.0))
    return _four(strategy.optimized_weight(signal, p, 60, low=0.0, high=1.0))


_MINI = "least(greatest((yy - xy) / (xx + yy - 2 * xy), 0.2), 0.8)"


@register("efficient_frontier_two", _sql(
    # the best asset at its upper bound, then the least variance within the bounds, if that is another portfolio
    "SELECT obs_date, CAST(corner AS INTEGER) AS corner, ticker, round(CASE ticker WHEN 'EVEN' THEN w ELSE 1 - w END + 3e-8, 4) AS weight, round((w * mx + (1 - w) * my) * 10000 + 3e-8, 4) AS mean, round(sqrt(252 * (w * w * xx + (1 - w) ** 2 * yy + 2 * w * (1 - w) * xy)) + 3e-8, 4) AS volatility "
    "FROM (SELECT *, 0 AS corner, w0 AS w FROM ef UNION ALL SELECT *, 1, w1 FROM ef WHERE abs(w1 - w0) > 1e-12) CROSS JOIN (VALUES ('EVEN'), ('ODD')) t(ticker)",
    *_TWO, _ENDS3,
    "tm2 AS (SELECT obs_date, avg(x) OVER w AS mx, avg(y) OVER w AS my, n FROM tw WINDOW w AS (ORDER BY obs_date ROWS 59 PRECEDING))",
    f"ef AS (SELECT tc.*, mx, my, CASE WHEN mx >= my THEN 0.8 ELSE 0.2 END AS w0, {_MINI} AS w1 FROM tc JOIN tm2 USING (obs_date) JOIN e3 USING (obs_date) WHERE n >= 60)",
))
def _(s, d):
    return _measured(strategy.efficient_frontiers(_returns(two(s, d)), _both(s, d).select("obs_date").distinct(), 60, 0.2, 0.8), "corner")


def _returns(p: DataFrame) -> DataFrame:
    return clean.ffill(p).withColumn("value", F.coalesce(F.col("value") / F.lag("value").over(Window.partitionBy("ticker").orderBy("obs_date")) - 1, F.lit(0.0)))


def _measured(df: DataFrame, *keys: str) -> DataFrame:
    return df.select("obs_date", *keys, "ticker", F.round(F.col("weight") + SHIFT, 4).alias("weight"), F.round(F.col("mean") * 10000 + SHIFT, 4).alias("mean"), F.round(F.col("volatility") + SHIFT, 4).alias("volatility"))


@register("frontier_blends_two", _sql(
    "SELECT obs_date, CAST(k AS INTEGER) AS point, ticker, round(CASE ticker WHEN 'EVEN' THEN w ELSE 1 - w END + 3e-8, 4) AS weight, round((w * mx + (1 - w) * my) * 10000 + 3e-8, 4) AS mean, round(sqrt(252 * (w * w * xx + (1 - w) ** 2 * yy + 2 * w * (1 - w) * xy)) + 3e-8, 4) AS volatility "
    f"FROM (SELECT *, (1 - k / 2.0) * {_LEAST} + k / 2.0 * CASE WHEN mx > my THEN 1.0 ELSE 0.0 END AS w FROM tc JOIN tm3 USING (obs_date) JOIN e3 USING (obs_date), (SELECT unnest(range(5)) AS k) WHERE n >= 60) CROSS JOIN (VALUES ('EVEN'), ('ODD')) t(ticker)",
    *_TWO, _ENDS3, "tm3 AS (SELECT obs_date, avg(x) OVER w AS mx, avg(y) OVER w AS my, n FROM tw WINDOW w AS (ORDER BY obs_date ROWS 59 PRECEDING))",
))
def _(s, d):
    """Five blends, from the least variance over equal parts to the greatest return."""
    return _measured(strategy.frontier_blends(_returns(two(s, d)), _both(s, d).select("obs_date").distinct(), 60, points=5), "point")


_NUMBERS = "(wa * wa * xx + wb * wb * yy + wc * wc * zz + 2 * (wa * wb * xy + wa * wc * xz + wb * wc * yz))"


@register("theoretical_mean_variance", _sql(
    # two equations leave one direction, orthogonal to both: the variance's least value along it
    f"SELECT obs_date, t.ticker, round(CASE t.ticker WHEN 'A' THEN wa WHEN 'B' THEN wb ELSE wc END + 3e-8, 4) AS weight, round((wa * m1 + wb * m2 + wc * m3) * 10000 + 3e-8, 4) AS mean, round(sqrt(252 * {_NUMBERS}) + 3e-8, 4) AS volatility, "
    f"round(2 * sqrt(252 * {_NUMBERS}) - (wa * m1 + wb * m2 + wc * m3) + 3e-8, 4) AS loss, round((0.5 * (greatest(m1, m2, m3) + least(m1, m2, m3)) - (wa * m1 + wb * m2 + wc * m3)) * 10000 + 3e-8, 4) AS short_of_target, round(abs(1 - wa - wb - wc), 4) AS slack "
    "FROM (SELECT *, a0 + q * v1 AS wa, b0 + q * v2 AS wb, c0 + q * v3 AS wc FROM (SELECT *, -(v1 * (a0 * xx + b0 * xy + c0 * xz) + v2 * (a0 * xy + b0 * yy + c0 * yz) + v3 * (a0 * xz + b0 * yz + c0 * zz)) / (v1 * v1 * xx + v2 * v2 * yy + v3 * v3 * zz + 2 * (v1 * v2 * xy + v1 * v3 * xz + v2 * v3 * yz)) AS q FROM hz)) CROSS JOIN (VALUES ('A'), ('B'), ('C')) t(ticker)",
    _ENDS3, *_THREE[:5],
    "hm3 AS (SELECT obs_date, avg(x) OVER w AS m1, avg(y) OVER w AS m2, avg(z) OVER w AS m3, row_number() OVER (ORDER BY obs_date) AS n FROM hx WINDOW w AS (ORDER BY obs_date ROWS 59 PRECEDING))",
    # a start that meets both: half of each of the best and the worst asset
    "hz AS (SELECT hc.*, m1, m2, m3, m2 - m3 AS v1, m3 - m1 AS v2, m1 - m2 AS v3, CASE WHEN m1 = greatest(m1, m2, m3) OR m1 = least(m1, m2, m3) THEN 0.5 ELSE 0 END AS a0, CASE WHEN m2 = greatest(m1, m2, m3) OR m2 = least(m1, m2, m3) THEN 0.5 ELSE 0 END AS b0, CASE WHEN m3 = greatest(m1, m2, m3) OR m3 = least(m1, m2, m3) THEN 0.5 ELSE 0 END AS c0 FROM hc JOIN hm3 USING (obs_date) JOIN e3 USING (obs_date) WHERE n >= 60)",
))
def _(s, d):
    """Least variance at half way between the least and the greatest mean return, and what the portfolio's measures say of it."""

    def make(means, cov):
        from .functions import optimize

        return optimize.analytic(cov, means, 0.5 * (means.max() + means.min()))

    out = strategy.portfolios(_returns(three(s, d)), _both(s, d).select("obs_date").distinct(), 60, make)
    day = Window.partitionBy("obs_date")
    means = _returns(three(s, d)).withColumn("m", F.avg("value").over(Window.partitionBy("ticker").orderBy("obs_date").rowsBetween(-59, 0))).groupBy("obs_date").agg((0.5 * (F.max("m") + F.min("m"))).alias("target"))
    named = out.join(means, "obs_date").withColumn("loss", F.round(2 * F.col("volatility") - F.col("mean") + SHIFT, 4)).withColumn("short_of_target", F.round((F.col("target") - F.col("mean")) * 10000 + SHIFT, 4))
    named = named.withColumn("slack", F.round(F.abs(1 - F.sum("weight").over(day)), 4))
    return _measured(named).join(named.select("obs_date", "ticker", "loss", "short_of_target", "slack"), ["obs_date", "ticker"])


@register("top_k_signal_best_dropped", _sql(
    "SELECT obs_date, ticker, CASE WHEN j <= 4 THEN NULL WHEN j IS NOT NULL THEN 1.0::DOUBLE END AS value FROM (SELECT *, CASE WHEN k2 IS NOT NULL THEN row_number() OVER (PARTITION BY obs_date ORDER BY k2 NULLS LAST, ticker) END AS j FROM "
    f"(SELECT *, CASE WHEN k > round_even(0.3 * n, 0) THEN k END AS k2 FROM (SELECT *, count(value) OVER (PARTITION BY obs_date) AS n, {_RANK.format('DESC')} AS k FROM rk)))",
    _TOP,
))
def _(s, d):
    """The best three tenths go, of the rest all but the first four."""
    return cross.top_k(rolling.holding_period_return(panel(s, d), 20), eligible(s, d), number=4, include=False, drop_best_fraction=0.3)


@register("universe_ever_eligible", _sql(
    f"SELECT obs_date, ticker, CASE WHEN n >= 18 THEN 1.0::DOUBLE END AS value FROM (SELECT *, count(value) {WT} ROWS 19 PRECEDING) AS n FROM g) JOIN me USING (obs_date) WHERE ticker IN (SELECT ticker FROM (SELECT *, count(value) {WT} ROWS 19 PRECEDING) AS n FROM g) JOIN me USING (obs_date) WHERE n >= 18)"
))
def _(s, d):
    """Only the tickers that pass the filter at some month's end."""
    p, u = _universe(s, d)
    return u.price_history(p, 20, 0.9).eligibility(only_eligible=True)


@register("rolling_mean_variance_two", _sql(
    # least volatility less return on x + y = 1: the derivative's root, kept within the bounds
    f"SELECT obs_date, ticker, round(value + 3e-8, 4) AS value FROM (SELECT obs_date, 'EVEN' AS ticker, x AS value FROM sol UNION ALL SELECT obs_date, 'ODD', 1 - x FROM sol UNION ALL SELECT obs_date, unnest(['EVEN', 'ODD']), 0.5 FROM tm WHERE n <= 12)",
    *_TWO,
    "tm AS (SELECT obs_date, n, x, y FROM (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS n, e / lag(e) OVER (ORDER BY obs_date) - 1 AS x, o / lag(o) OVER (ORDER BY obs_date) - 1 AS y FROM "
    "(SELECT obs_date, max(v) FILTER (ticker = 'EVEN') AS e, max(v) FILTER (ticker = 'ODD') AS o FROM tf JOIN me USING (obs_date) GROUP BY 1)))",
    "ts AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS n, x, y FROM tm WHERE x IS NOT NULL)",
    "tq AS (SELECT obs_date, n, var_samp(x) OVER w AS xx, var_samp(y) OVER w AS yy, covar_samp(x, y) OVER w AS xy, avg(x) OVER w - avg(y) OVER w AS d FROM ts WINDOW w AS (ORDER BY obs_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))",
    "tk AS (SELECT *, 252 * (xx + yy - 2 * xy) AS a, 252 * 2 * (xy - yy) AS b, 252 * yy AS c FROM tq WHERE n > 12)",
    "sol AS (SELECT obs_date, least(greatest(CASE WHEN a > d * d THEN (sign(d) * sqrt(d * d * (4 * a * c - b * b) / (a - d * d)) - b) / (2 * a) WHEN d > 0 THEN 1.0 ELSE 0.0 END, 0.0), 1.0) AS x FROM tk)",
).replace("FROM tm WHERE n <= 12", "FROM ts WHERE n <= 12"))
def _(s, d):
    p = clean.ffill(two(s, d))
    monthly = rolling.pct_change_pad(p.join(month_ends(p), "obs_date", "left_semi"), 1)
    return _four(strategy.rolling_mean_variance(clean.drop_incomplete_dates(monthly), 12, min_total=1.0, max_total=1.0, return_target=-1.0))


@register("optimized_weight", None)
def _(s, d):
    return strategy.optimized_weight(eligible(s, d), panel(s, d), 60, low=0.0, high=0.3)


@register("optimized_weight_conditions", _sql("SELECT obs_date, count(value) AS n, 1.0::DOUBLE AS total, true AS within, 0.0::DOUBLE AS violation FROM el GROUP BY 1"))
def _(s, d):
    """Optima of all eligible tickers meet the conditions of Karush, Kuhn and Tucker, whose measures are computed from the returns anew.

    A ticker's gradient is its covariance with the portfolio. Off the bounds all are equal; who stands at 0 has at least that, who stands at 0.3 at most. The
    greatest violation is told as a share of the mean variance, to three digits.
    """
    signal, p = eligible(s, d), panel(s, d)
    w = strategy.optimized_weight(signal, p, 60, low=0.0, high=0.3).join(signal.where("value is not null").select("obs_date", "ticker"), ["obs_date", "ticker"])
    held = asof.trailing_slices(_returns(p), signal, 60).join(w.select(F.col("obs_date").alias("slice_date"), "ticker", F.col("value").alias("w")), ["slice_date", "ticker"])
    basket = held.groupBy("slice_date", "obs_date").agg(F.sum(F.col("w") * F.col("value")).alias("b"))
    each = held.join(basket, ["slice_date", "obs_date"]).groupBy("slice_date", "ticker").agg(F.first("w").alias("w"), F.covar_samp("value", "b").alias("g"), F.var_samp("value").alias("v"))
    free = (F.col("w") > 1e-4) & (F.col("w") < 0.3 - 1e-4)
    level = F.coalesce(F.avg(F.when(free, F.col("g"))).over(Window.partitionBy("slice_date")), F.max(F.when(F.col("w") > 1e-4, F.col("g"))).over(Window.partitionBy("slice_date")))
    off = each.withColumn("level", level).withColumn("off", F.when(free, F.abs(F.col("g") - F.col("level"))).when(F.col("w") <= 1e-4, F.greatest(F.col("level") - F.col("g"), F.lit(0.0))).otherwise(F.greatest(F.col("g") - F.col("level"), F.lit(0.0))))
    within = (F.min("w") >= -1e-9) & (F.max("w") <= 0.3 + 1e-9)
    out = off.groupBy(F.col("slice_date").alias("obs_date")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("total"), within.alias("within"), F.round(F.max("off") / F.avg("v"), 3).alias("violation"))
    return out


@register("rolling_mean_variance", None)
def _(s, d):
    returns = rolling.pct_change_pad(clean.ffill(panel(s, d)), 1)
    months = month_ends(returns)
    monthly = clean.drop_incomplete_dates(returns.join(months, "obs_date", "left_semi"))
    return strategy.rolling_mean_variance(monthly, 12, min_total=1.0, max_total=1.0)


_FUTURES = (
    "nd AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS no FROM days)",
    "cu AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS rank, CAST((SELECT min(obs_date) FROM days) + to_months(CAST(3 * row_number() OVER (ORDER BY ticker) AS INTEGER)) AS DATE) AS expiry FROM names)",
    "ce AS (SELECT cu.*, (SELECT max(no) FROM nd WHERE nd.obs_date <= cu.expiry) AS e_no, expiry >= (SELECT max(obs_date) FROM days) AS open FROM cu)",
    "cs AS (SELECT *, CASE WHEN open THEN (SELECT max(no) FROM nd) ELSE e_no - 1 END AS to_no FROM (SELECT *, count(*) FILTER (open) OVER (ORDER BY rank) AS opened FROM ce WHERE e_no IS NOT NULL) WHERE NOT open OR opened = 1)",
    "sg AS (SELECT *, list_reverse_sort(list_filter(list_transform(range(1, 20), lambda i: expiry - CAST(i AS INTEGER)), lambda x: isodow(x) <= 5))[5] AS expected FROM (SELECT *, coalesce(lag(to_no) OVER (ORDER BY rank), 1) AS from_no FROM cs) WHERE to_no >= from_no)",
    "sd AS (SELECT sg.rank, nd.no, nd.obs_date, CASE WHEN CASE WHEN open THEN nd.obs_date >= expected ELSE nd.no > to_no - 5 END THEN 0.0 ELSE 1.0 END AS raw FROM sg JOIN nd ON nd.no BETWEEN from_no AND to_no)",
    "sw AS (SELECT *, CASE WHEN count(raw) OVER w >= 5 THEN avg(raw) OVER w END AS w5 FROM sd WINDOW w AS (PARTITION BY rank ORDER BY no ROWS 4 PRECEDING))",
    "sh AS (SELECT *, first_value(w5 IGNORE NULLS) OVER (PARTITION BY rank ORDER BY no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM sw)",
    "lg AS (SELECT sh.rank, no, obs_date, position, after, 0.5 * CASE after WHEN 0 THEN share ELSE 1 - share END AS weight, rank + position - 1 + after AS held FROM sh, (VALUES (1), (2)) p(position), (VALUES (0), (1)) a(after))",
    f"bf AS (SELECT obs_date, ticker, coalesce(fv, first_value(fv IGNORE NULLS) {WT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM f)",
    "lp AS (SELECT lg.*, last_value(v IGNORE NULLS) OVER (PARTITION BY lg.rank, position, after ORDER BY no ROWS UNBOUNDED PRECEDING) AS p FROM lg LEFT JOIN (SELECT cu.rank AS held, bf.obs_date, v FROM bf JOIN cu USING (ticker)) c ON c.held = lg.held AND c.obs_date = lg.obs_date)",
    "lr AS (SELECT *, p / lag(p) OVER (PARTITION BY rank, position, after ORDER BY no) - 1 AS ret FROM lp)",
    "lh AS (SELECT * FROM (SELECT *, count(ret + weight) OVER (PARTITION BY rank, no) = 4 AS whole FROM lr) WHERE whole OR rank = (SELECT min(rank) FROM sg))",
    "lt AS (SELECT *, ret * lag(weight) OVER w AS t, CASE WHEN after = 1 THEN greatest(abs(weight) - lag(abs(weight)) OVER w, 0) END AS c FROM lh WINDOW w AS (PARTITION BY position, after ORDER BY no, rank))",
    "ld AS (SELECT obs_date, coalesce(sum(t), 0) AS r, 2 * coalesce(sum(c), 0) AS c FROM lt GROUP BY 1)",
    "ln AS (SELECT obs_date, r, r - 0.0005 * c - 0.01 * date_diff('day', lag(obs_date) OVER (ORDER BY obs_date), obs_date) / 365.0 AS net FROM ld)",
)


@register("rolling_futures_index", _sql(
    f"SELECT obs_date, {_r('r', 'index_return')}, {_r('product(1 + r) OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING)', 'value')}, {_r('net', 'net_return')}, {_r('CASE WHEN net IS NOT NULL THEN product(1 + net) OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING) END', 'net_value')} FROM ln", *_FUTURES
))
def _(s, d):
    """Brands as contracts that expire one after another, three months apart."""
    p = panel(s, d)
    names = p.groupBy("ticker").agg(F.min("obs_date").alias("f")).withColumn("k", F.row_number().over(Window.orderBy("ticker")))
    first = p.agg(F.min("obs_date")).first()[0]
    expiries = names.select("ticker", F.add_months(F.lit(first), F.col("k") * 3).alias("expiry"))
    return rounded(futures.rolling_index(clean.bfill(clean.ffill(p)), expiries, {1: 0.5, 2: 0.5}, 5, 1, 0.0005, 0.01), "index_return", "value", "net_return", "net_value")


_HALL = (
    "dm0 AS (SELECT days.obs_date, max(me.obs_date) AS at FROM days LEFT JOIN me ON me.obs_date <= days.obs_date GROUP BY 1)",
    f"h0 AS (SELECT f.obs_date, f.ticker, f.fv / lag(f.fv) OVER (PARTITION BY f.ticker ORDER BY f.obs_date) - 1 AS ret, ew.value AS w0 FROM f JOIN dm0 USING (obs_date) LEFT JOIN ew ON ew.obs_date = dm0.at AND ew.ticker = f.ticker)",
    f"bw AS (SELECT obs_date, ticker, ret, avg(w0) {WT} ROWS 4 PRECEDING) AS weight FROM h0)",
    _HEDGE[0],
    _HEDGE[1],
    "hs AS (SELECT obs_date, -CASE WHEN count(beta * weight) = count(*) THEN sum(beta * weight) END AS weight FROM hb JOIN bw USING (obs_date, ticker) GROUP BY 1)",
    "hw AS (SELECT obs_date, ticker, ret, weight FROM bw UNION ALL SELECT obs_date, 'MARKET', m.ret, hs.weight FROM (SELECT obs_date, value / lag(value) OVER (ORDER BY obs_date) - 1 AS ret FROM mkt) m JOIN hs USING (obs_date))",
    f"g1 AS (SELECT obs_date, CASE WHEN count(t) = count(*) THEN sum(t) END AS value FROM (SELECT obs_date, ret * lag(weight) {WT}) AS t FROM hw) GROUP BY 1)",
    f"gv AS (SELECT obs_date, CASE WHEN count(value) OVER (ORDER BY obs_date ROWS 5 PRECEDING) > 0 THEN last_value(m IGNORE NULLS) OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING) END AS v FROM (SELECT g1.*, m FROM g1 LEFT JOIN (SELECT obs_date, {_guard('stddev_samp(value)', 'value', 60, 'OVER (ORDER BY obs_date')} * sqrt(252.0) AS m FROM g1 WHERE value IS NOT NULL) USING (obs_date)))",
    "vw AS (SELECT hw.obs_date, ticker, ret, weight * least(0.05 / v, 1.0) AS weight FROM hw JOIN (SELECT obs_date, CASE WHEN v > 0 THEN v END AS v FROM gv) USING (obs_date))".replace("least(0.05 / v, 1.0)", "CASE WHEN v IS NOT NULL THEN least(0.05 / v, 1.0) END"),
    f"g2 AS (SELECT obs_date, CASE WHEN count(t) = count(*) THEN sum(t) END AS gross, coalesce(sum(c), 0) AS c FROM (SELECT obs_date, ret * lag(weight) {WT}) AS t, abs(weight - lag(weight) {WT})) AS c FROM vw) GROUP BY 1)",
    "g3 AS (SELECT obs_date, gross, gross - 0.0005 * c - 0.01 * dt + 0.01 * dt * h AS net FROM (SELECT g2.*, date_diff('day', lag(obs_date) OVER (ORDER BY obs_date), obs_date) / 365.0 AS dt, lag(hs.weight) OVER (ORDER BY obs_date) AS h FROM g2 JOIN hs USING (obs_date)))",
)


def _level(r: str) -> str:
    over = "OVER (ORDER BY obs_date ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {r} IS NOT NULL THEN 100 * product(1 + {r}) {over} WHEN lead({r}) OVER (ORDER BY obs_date) IS NOT NULL AND count({r}) {over} = 0 THEN 100 END"


@register("index_hedged", _sql(f"SELECT obs_date, {_r('gross', 'gross_return')}, {_r(_level('gross'), 'gross')}, {_r('net', 'net_return')}, {_r(_level('net'), 'net')} FROM g3", _EW[0], *_HALL))
def _(s, d):
    returns = rolling.pct_change_pad(clean.ffill(panel(s, d)))
    out = strategy.index_hedged(returns, strategy.equal_weight(eligible(s, d)), transaction_cost=0.0005, fee=0.01, smoothing=5, volatility_target=0.05, market=market(s, d), beta_lags=60, carry=0.01)
    return rounded(out, "gross_return", "gross", "net_return", "net")


@register("volatility_target_smoothed", _sql(
    f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", *_DW, *_VT, f"vs AS (SELECT obs_date, ticker, ret, {_guard('avg(weight)', 'weight', 3)} AS weight FROM vw)", *_index(2, 0, 0, "vs")
))
def _(s, d):
    return rounded(_strategy(s, d, overlays=strategy.VolatilityTarget(0.05, smoothing=3)).back_test())


@register("overlay_chain", _sql(
    f"SELECT obs_date, {_r('value')} FROM lv WHERE value IS NOT NULL", *_DW, *_HEDGE, *(x.replace("FROM bw", "FROM hw").replace("SELECT bw.obs_date, bw.ticker, ret", "SELECT hw.obs_date, hw.ticker, ret").replace("FROM hw JOIN sk", "FROM hw JOIN sk") for x in _VT), *_index(2, 0.001, 0, "vw")
))
def _(s, d):
    """A beta hedge, then a volatility target over basket and hedge."""
    return rounded(_strategy(s, d, overlays=[strategy.BetaHedge(market(s, d), lags=60), strategy.VolatilityTarget(0.05)], transaction_cost=0.001).back_test())


@register("universe_combined", _sql(
    f"SELECT obs_date, ticker, CASE WHEN n >= 12 AND a.value > 30 THEN 1.0::DOUBLE END AS value FROM (SELECT *, count(value) {WT} ROWS 19 PRECEDING) AS n FROM g) x JOIN me USING (obs_date) JOIN a USING (obs_date, ticker)",
    "lq AS (SELECT obs_date, ticker, volume AS value FROM g WHERE volume IS NOT NULL)", _stale(_guard("avg(value)", "value", 10), "lq", "a"),
))
def _(s, d):
    p, u = _universe(s, d)
    return u.price_history(p, 20, 0.6).liquidity(panel(s, d, "volume"), 10, 30).eligibility()


@register("universe_custom", _sql("SELECT obs_date, ticker, CASE WHEN CAST(right(ticker, 1) AS INT) % 2 = 0 THEN 1.0::DOUBLE END AS value FROM me CROSS JOIN names"))
def _(s, d):
    p, u = _universe(s, d)
    even = p.withColumn("value", F.when(F.substring("ticker", -1, 1).cast("int") % 2 == 0, 1.0).otherwise(0.0))
    return u.custom(even).eligibility()


@register("monthly_table", _sql(
    "SELECT ticker, y AS year, " + ", ".join(f"round(max(r) FILTER (m = {k + 1}) + 3e-8, 6) AS {n}" for k, n in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))) + ", round(product(1 + r) - 1 + 3e-8, 6) AS yearly_return "
    "FROM (SELECT ticker, y, m, e / coalesce(lag(e) OVER (PARTITION BY ticker ORDER BY y, m), s) - 1 AS r FROM (SELECT ticker, year(obs_date)::INT AS y, month(obs_date)::INT AS m, arg_max(value, obs_date) AS e, arg_min(value, obs_date) AS s FROM pub GROUP BY 1, 2, 3)) GROUP BY 1, 2"
))
def _(s, d):
    out = report.monthly_table(panel(s, d))
    return rounded(out, *[c for c in out.columns if c not in ("ticker", "year")])
