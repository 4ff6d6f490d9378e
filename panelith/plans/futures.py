"""Rolling futures: roll calendar, continuous weights and the index.

The curve's contracts are ranked by expiry. Between two roll ends a position holds the n-th contract and rolls linearly into the next over
the last ``roll_days`` rows. The segments of all expiries are rows of one plan; no loop runs over them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.calendar import business_shift, year_fraction
from ..operators.clean import ffill
from ..operators.frames import last_rows, skip_sum
from .strategy import on_dates


# Commodities by the first two characters of their tickers, and the months in which their contracts roll.
COMMODITIES = {
    "CL": ("WTI Crude Oil", ("H", "K", "N", "U", "X", "F")),
    "CO": ("Brent Crude Oil", ("H", "K", "N", "U", "X", "F")),
    "HO": ("ULS Diesel", ("H", "K", "N", "U", "X", "F")),
    "XB": ("RBOB Gasoline", ("H", "K", "N", "U", "X", "F")),
    "NG": ("Natural Gas", ("H", "K", "N", "U", "X", "F")),
    "SI": ("Silver", ("H", "K", "N", "U", "Z")),
    "GC": ("Gold", ("G", "J", "M", "Q", "Z")),
    "PL": ("Platinum", ("J", "N", "V", "F")),
    "HG": ("Copper", ("H", "K", "N", "U", "Z", "F")),
    "LA": ("Aluminum", ("H", "K", "N", "U", "X", "F")),
    "LN": ("Nickel", ("H", "K", "N", "U", "X", "F")),
    "LX": ("Zinc", ("H", "K", "N", "U", "X", "F")),
    "LL": ("Lead", ("H", "K", "N", "U", "X", "F")),
    "LT": ("Tin", ("H", "K", "N", "U", "X", "F")),
    "LC": ("Live Cattle", ("G", "J", "M", "Q", "V", "Z")),
    "LH": ("Lean Hogs", ("G", "J", "M", "N", "Q", "V", "Z")),
    "BO": ("Soybean Oil", ("H", "K", "N", "Z", "F")),
    "SM": ("Soybean Meal", ("H", "K", "N", "Z", "F")),
    "S ": ("Soybeans", ("H", "K", "N", "X", "F")),
    "C ": ("Corn", ("H", "K", "N", "U", "Z")),
    "W ": ("Chicago Wheat", ("H", "K", "N", "U", "Z")),
    "KW": ("KC HRW Wheat", ("H", "K", "N", "U", "Z")),
    "CC": ("Cocoa", ("H", "K", "N", "U", "Z")),
    "CT": ("Cotton", ("H", "K", "N", "Z")),
    "SB": ("Sugar", ("H", "K", "N", "V")),
    "KC": ("Coffee", ("H", "K", "N", "U", "Z")),
}


def roll_months(code: str) -> list[str]:
    """The month codes of a commodity's contracts that are rolled."""
    return list(COMMODITIES[code.upper()][1])


def named(code: str, allocation: Mapping[int, float]) -> tuple[str, str]:
    """Ticker and description of a rolling strategy."""
    name = COMMODITIES[code.upper()][0]
    sides = {k: "LONG" if w > 0 else "SHORT" for k, w in allocation.items()}
    ticker = "_".join([name.upper().replace(" ", "_"), *(f"{sides[k]}_{k}_FUT" for k in allocation)]) + " INDEX"
    parts = [f"{sides[k]} {round(abs(w) * 100, 2)}% {k}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(k, 'th') } future" for k, w in allocation.items()]
    return ticker, f"{name} rolling futures strategy. {' ,'.join(parts)}."


def expiry_texts(instruments: DataFrame, expiries: DataFrame) -> DataFrame:
    """(ticker, description) of the futures among the instruments, from the last trading days (ticker, expiry)."""
    futures = instruments.where("instrument_type = 'FUTURE'").select("ticker")
    return expiries.join(futures, "ticker", "left_semi").select("ticker", F.concat(F.lit("EXPIRY "), F.date_format("expiry", "yyyy-MM-dd")).alias("description"))


def update_contracts(store, source, tickers: list[str] | DataFrame, expiries: DataFrame | None = None, today=None) -> None:
    """Adds the contracts that the store lacks, writes their expiries into their descriptions and refreshes all. ``tickers`` may be a table."""
    store.ingest(source, tickers, refresh=False)
    if expiries is not None:
        names = tickers.select(F.upper("ticker").alias("ticker")) if isinstance(tickers, DataFrame) else store.spark.createDataFrame([(t.upper(),) for t in tickers], "ticker string")
        store.update_attributes(expiry_texts(store.instruments(), expiries.join(names, "ticker", "left_semi")))
    store.refresh(source, tickers, today=today)


def universe(instruments: DataFrame, code: str, month_codes: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Futures of an underlying, by ticker prefix and month codes, that traded in the span; ordered by expiry."""
    hit = F.lit(False)
    for prefix in [code.upper() + m.upper() for m in month_codes] if month_codes else [code.upper()]:
        hit = hit | F.col("ticker").startswith(prefix)
    out = instruments.where(hit & (F.col("instrument_type") == "FUTURE"))
    out = out if start is None else out.where(F.col("latest_obs_date") > F.lit(start).cast("date"))
    out = out if end is None else out.where(F.col("oldest_obs_date") < F.lit(end).cast("date"))
    if not out.take(1):
        raise ValueError(f"no futures of {code}")
    return out.withColumn("expiry", text.expiry_of(F.col("description"))).orderBy("description")


def chain(contracts: DataFrame, most: int | None = None) -> DataFrame:
    """generic, position, ticker, start, end: which contract is the n-th live one, from when to when.

    ``contracts`` holds generic, ticker, listed and expiry; a contract is live from its listing to its expiry, and live ones stand in order of expiry
    and ticker. Ranks change where a contract lists or has expired only: between two such dates the live contracts are ranked once,
    and neighbouring intervals with the same holder are joined. ``most`` is the number of positions that is wanted.
    """
    if most is not None and most < 1:
        raise ValueError("at least one position is wanted")
    live = contracts.select(F.upper("generic").alias("generic"), F.upper("ticker").alias("ticker"), F.to_date("listed").alias("listed"), F.to_date("expiry").alias("expiry")).where("listed <= expiry").distinct()
    by_generic = Window.partitionBy("generic").orderBy("at")
    events = live.select("generic", F.explode(F.array("listed", F.date_add("expiry", 1))).alias("at")).distinct().withColumn("k", F.row_number().over(by_generic))
    spans = events.withColumn("end", F.date_sub(F.lead("at").over(by_generic), 1)).select("generic", "k", F.col("at").alias("start"), "end")
    first, past = (events.select("generic", F.col("at").alias(d), F.col("k").alias(n)) for d, n in (("listed", "k0"), ("gone", "k1")))
    held = live.join(first, ["generic", "listed"]).withColumn("gone", F.date_add("expiry", 1)).join(past, ["generic", "gone"])
    each = held.select("generic", "ticker", "expiry", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)).alias("k"))
    ranked = each.withColumn("position", F.row_number().over(Window.partitionBy("generic", "k").orderBy("expiry", "ticker")))
    ranked = ranked if most is None else ranked.where(F.col("position") <= most)
    run = F.col("k") - F.row_number().over(Window.partitionBy("generic", "position", "ticker").orderBy("k"))
    runs = ranked.withColumn("run", run).groupBy("generic", "position", "ticker", "run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    a, b = spans.select("generic", F.col("k").alias("k0"), "start"), spans.select("generic", F.col("k").alias("k1"), "end")
    return runs.join(a, ["generic", "k0"]).join(b, ["generic", "k1"]).select("generic", "position", "ticker", "start", "end")


def chain_on(contracts: DataFrame, calendar: DataFrame, most: int | None = None) -> DataFrame:
    """obs_date, generic, position, ticker: the chains on the dates of a calendar. A date is placed by the last change of a chain up to it."""
    held = chain(contracts, most)
    dates = calendar.select("obs_date").distinct().crossJoin(held.select("generic", "position").distinct())
    both = held.select("generic", "position", F.col("start").alias("obs_date"), F.struct("ticker", "end").alias("now")).unionByName(dates.withColumn("now", F.lit(None).cast("struct<ticker: string, end: date>")), allowMissingColumns=True)
    # the row of a start stands before the calendar's row of that date
    order = Window.partitionBy("generic", "position").orderBy("obs_date", F.col("now").isNull())
    last = F.last("now", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("last", last).where(F.col("now").isNull() & (F.col("obs_date") <= F.col("last.end")))
    return found.select("obs_date", "generic", "position", F.col("last.ticker").alias("ticker"))


def roll_calendar(expiries: DataFrame, roll_days: int = 5, buffer: int = 1) -> DataFrame:
    """ticker, roll_start, roll_end, expiry by business days."""
    if roll_days < 1 or buffer < 0:
        raise ValueError("roll_days >= 1 and buffer >= 0 are needed")
    return expiries.select("ticker", business_shift(F.col("expiry"), -(roll_days + buffer)).alias("roll_start"), business_shift(F.col("expiry"), -buffer).alias("roll_end"), "expiry").orderBy("expiry")


def settled(prices: DataFrame) -> DataFrame:
    """Filled forward up to each contract's last price."""
    last = F.max(F.when(F.col("value").isNotNull(), F.col("obs_date"))).over(Window.partitionBy("ticker"))
    p = prices.withColumn("__last", last)
    return ffill(p).withColumn("value", F.when(F.col("obs_date") <= F.col("__last"), F.col("value"))).drop("__last")


def rolling_index(prices: DataFrame, expiries: DataFrame, allocation: float | Mapping[int, float] = 1.0, roll_days: int = 5, buffer: int = 1, transaction_cost: float = 0.0, fee: float = 0.0) -> DataFrame:
    """obs_date, index_return, value, net_return, net_value. ``prices`` is a dense panel, ``expiries`` holds ticker and expiry.

    An expiry that is no trading date counts as the last trading date before it.
    """
    if roll_days < 1 or buffer < 0:
        raise ValueError("roll_days >= 1 and buffer >= 0 are needed")
    positions = dict(allocation) if isinstance(allocation, Mapping) else {1: float(allocation)}
    if not positions or any(int(k) != k or k < 1 for k in positions):
        raise ValueError("the allocation is by positions from 1 on")
    spark = prices.sparkSession
    dates = prices.select("obs_date").distinct().withColumn("no", F.row_number().over(on_dates()))
    bounds = dates.agg(F.max("obs_date").alias("__end"), F.max("no").alias("__n"), F.min("obs_date").alias("__begin"))
    curve = expiries.select("ticker", F.col("expiry").cast("date").alias("expiry")).withColumn("rank", F.row_number().over(Window.orderBy("expiry", "ticker")))
    # per expiry: where its segment ends; the first that the data do not pass is the open one and the last
    at = curve.crossJoin(bounds).join(dates.select(F.col("obs_date").alias("d"), F.col("no").alias("e_no")), F.col("d") <= F.col("expiry"), "left")
    ends = at.groupBy("rank", "expiry", "__end", "__n").agg(F.max("e_no").alias("e_no")).where("e_no is not null")
    by_rank = Window.orderBy("rank")
    ends = ends.withColumn("open", F.col("expiry") >= F.col("__end")).withColumn("__opened", F.sum(F.col("open").cast("int")).over(by_rank))
    ends = ends.where("not open or __opened = 1").withColumn("to_no", F.when(F.col("open"), F.col("__n")).otherwise(F.col("e_no") - buffer))
    seg = ends.withColumn("from_no", F.coalesce(F.lag("to_no").over(by_rank), F.lit(1))).where("to_no >= from_no")
    seg = seg.withColumn("expected", business_shift(F.col("expiry"), -(roll_days + buffer - 1)))
    rows = seg.select("rank", "open", "expected", "from_no", "to_no", F.explode(F.sequence("from_no", "to_no")).alias("no")).join(dates, "no")
    flat = F.when(F.col("open"), F.col("obs_date") >= F.col("expected")).otherwise(F.col("no") > F.col("to_no") - roll_days)
    in_seg = Window.partitionBy("rank").orderBy("no")
    raw = F.when(flat, 0.0).otherwise(1.0)
    rows = rows.withColumn("__raw", raw)
    full = last_rows(in_seg, roll_days)
    rows = rows.withColumn("__w", F.when(F.count("__raw").over(full) >= roll_days, F.avg("__raw").over(full)))
    rows = rows.withColumn("share", F.first("__w", ignorenulls=True).over(in_seg.rowsBetween(0, Window.unboundedFollowing))).select("rank", "no", "obs_date", "from_no", "share")
    pos = spark.createDataFrame([(int(k), float(v)) for k, v in positions.items()], "position int, allocation double")
    legs = rows.crossJoin(F.broadcast(pos)).select("*", F.explode(F.array(F.struct(F.lit(0).alias("after"), F.col("share").alias("s")), F.struct(F.lit(1).alias("after"), (1 - F.col("share")).alias("s")))).alias("leg"))
    legs = legs.select("rank", "no", "obs_date", "from_no", "position", F.col("leg.after").alias("after"), (F.col("allocation") * F.col("leg.s")).alias("weight"), (F.col("rank") + F.col("position") - 1 + F.col("leg.after")).alias("held"))
    closes = settled(prices).join(curve.select("ticker", F.col("rank").alias("held")), "ticker").select("held", "obs_date", "value")
    legs = legs.join(closes, ["held", "obs_date"], "left")
    in_leg = Window.partitionBy("rank", "position", "after").orderBy("no")
    filled = F.last("value", ignorenulls=True).over(last_rows(in_leg, None))
    legs = legs.withColumn("__p", filled).withColumn("ret", F.col("__p") / F.lag("__p").over(in_leg) - 1)
    # later segments start after their first row, which is the last of the segment before, and hold complete rows only
    whole = F.count(F.col("ret") + F.col("weight")).over(Window.partitionBy("rank", "no")) == 2 * len(positions)
    lead = rows.agg(F.min("rank").alias("__first"))
    legs = legs.withColumn("__whole", whole).crossJoin(F.broadcast(lead)).where("rank = __first or __whole")
    in_curve = Window.partitionBy("position", "after").orderBy("no", "rank")
    legs = legs.withColumn("__t", F.col("ret") * F.lag("weight").over(in_curve))
    legs = legs.withColumn("__c", F.when(F.col("after") == 1, F.greatest(F.abs("weight") - F.lag(F.abs("weight")).over(in_curve), F.lit(0.0))))
    daily = legs.groupBy("obs_date").agg(skip_sum(F.col("__t")).alias("index_return"), (2 * skip_sum(F.col("__c"))).alias("__c"))
    net = F.col("index_return") - transaction_cost * F.col("__c") - fee * year_fraction(365)
    daily = daily.withColumn("net_return", net)
    so_far = last_rows(on_dates(), None)
    return daily.select("obs_date", "index_return", F.product(1 + F.col("index_return")).over(so_far).alias("value"), "net_return", F.when(F.col("net_return").isNotNull(), F.product(1 + F.col("net_return")).over(so_far)).alias("net_value"))

