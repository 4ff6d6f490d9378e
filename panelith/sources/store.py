"""The panel store: instruments and facts as tables, and what is read from and written to them.

Facts are long, ``(field, obs_date, ticker, value, source, created_at)``, in batches of Parquet by field and year (see ``commits``). A commit writes
what is new or gone to folders of its own and then creates the next file of the log, which lists the folders that count. Creating a file
that exists fails, so of two writers one looks again at what the other left and adds its own to it; readers follow the log and never see half of a commit.

Tickers are given as a list or as a DataFrame with a column ``ticker``; a DataFrame is joined and never collected.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import asof, clean
from ..operators.frames import by_ticker, dense, last_rows
from .commits import FACT_SCHEMA, Conflict, Facts, Log
from .readers import FIELDS, Source
from .shared import materialized
from ..plans.demand import StoredPanel

# What instruments may be, and the fields they may not have.
INSTRUMENT_TYPES = ("STOCK", "INDEX", "FUTURE", "ETF", "BOND", "FX")
DATA_SOURCES = ("YAHOO", "BLOOMBERG", "BORSDATA", "EXCEL")
WITHOUT_FIELD = {"volume": ("INDEX",), "dividend": ("INDEX", "FX", "BOND"), "split": ("INDEX", "FX", "BOND")}

Tickers = Sequence[str] | DataFrame
DATES_FREE = ("ticker", "has_dividend_history", "first_ex_div_date", "expiry_date", "latest_obs_date", "oldest_obs_date")


def total_return(prices: DataFrame, dividends: DataFrame, tax: float = 0.0) -> DataFrame:
    """Prices with dividends, net of tax, reinvested at the last price before the ex-date. NULL where the price is."""
    if tax < 0:
        raise ValueError("the tax is not negative")
    w = by_ticker()
    paid = dividends.groupBy("obs_date", "ticker").agg(F.sum("value").alias("__d"))
    p = prices.join(paid, ["obs_date", "ticker"], "left").withColumn("__p", F.last("value", ignorenulls=True).over(last_rows(w, None)))
    before = F.lag("__p").over(w)
    growth = F.coalesce(F.col("__p") / before - 1, F.lit(0.0)) + F.coalesce(F.col("__d") / before * (1 - tax), F.lit(0.0))
    p = p.withColumn("__g", 1 + growth)
    level = F.product("__g").over(last_rows(w, None)) * F.first("value", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("obs_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return p.withColumn("value", F.when(F.col("value").isNotNull(), level)).select("obs_date", "ticker", "value")


def convert(panel: DataFrame, instruments: DataFrame, fx: DataFrame, currency: str) -> DataFrame:
    """Values in another currency: fx holds closes of ``<PRICE>_<BASE>.FX`` tickers, taken as of the panel's dates."""
    currency = currency.upper()
    own = instruments.select("ticker", F.upper("currency").alias("__ccy"))
    named = panel.join(own, "ticker", "left").withColumn("__fx", F.when(F.col("__ccy") != currency, text.fx_ticker(F.lit(currency), F.col("__ccy"))))
    wanted = named.where("__fx is not null").select(F.col("__fx").alias("ticker"), "obs_date").distinct()
    rates = asof.per_ticker(wanted, fx.where("value is not null"), alias="__rate").select(F.col("ticker").alias("__fx"), "obs_date", "__rate")
    joined = named.join(rates, ["__fx", "obs_date"], "left")
    return joined.withColumn("value", F.col("value") * F.when(F.col("__fx").isNull(), F.lit(1.0)).otherwise(F.col("__rate"))).select(*panel.columns)


class PanelStore:
    """``slot_rows``: about so many rows make a slot; ``most_batches``: a partition of more batches is folded by the next upsert."""

    def __init__(self, spark: SparkSession, path: str, slot_rows: int = 2_000_000, most_batches: int = 8):
        self.spark, self.path, self.most_batches = spark, path.rstrip("/"), most_batches
        self.log, self._facts = Log(spark, f"{self.path}/log"), Facts(spark, self.path, slot_rows)

    # commits

    def _commit(self, change: Callable[[dict, int], dict | None]) -> None:
        """Logs what ``change`` makes of the latest state, given the commit's number; it is asked again if another writer was faster."""
        for _ in range(20):
            number, state = self.log.latest()
            new = change(state, number + 1)
            if new is None:
                return
            try:
                return self.log.append(number + 1, new)
            except Conflict:
                continue
        raise RuntimeError("other writers were faster twenty times")

    def _with_instruments(self, state: dict, change: Callable[[DataFrame], DataFrame]) -> dict:
        batch = uuid.uuid4().hex
        change(self._table(state)).write.parquet(f"{self.path}/instruments/{batch}")
        return state | {"instruments": batch}

    def _change_instruments(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self._commit(lambda state, number: self._with_instruments(state, change))

    def _names(self, tickers: Tickers) -> DataFrame:
        """The tickers as a table, in upper case, each once."""
        if isinstance(tickers, DataFrame):
            return tickers.select(F.upper("ticker").alias("ticker")).distinct()
        return self.spark.createDataFrame([(t,) for t in dict.fromkeys(t.upper() for t in ([tickers] if isinstance(tickers, str) else tickers))], "ticker string")

    def _among(self, rows: DataFrame, tickers: Tickers) -> DataFrame:
        return rows.join(self._names(tickers), "ticker", "left_semi")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _drop(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def vacuum(self) -> None:
        """Deletes what the present state doesn't list, and the log up to it. No reader or writer may be at work."""
        _, state = self.log.latest()
        batches = {f"batch={b}" for b in state["batches"]}
        kept = {"facts": batches, "summaries": batches, "gone": {g[0] for g in state["gone"]}, "instruments": {state["instruments"]}, "staging": set()}
        for folder, held in kept.items():
            p, fs = self._fs(f"{self.path}/{folder}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.getPath().getName() not in held:
                    fs.delete(f.getPath(), True)
        self.log.trim()

    def compact(self, field: str | None = None, start=None, end=None) -> None:
        """Folds the batches and deletions of the partitions of a field and span of years into one batch each."""
        lo, hi = (None if d is None else int(str(d)[:4]) for d in (start, end))

        def change(state: dict, number: int) -> dict | None:
            entries = self._facts.entries(state, field, lo, hi)
            counts = Counter((e[0], e[1]) for e in entries)
            due = {(e[0], e[1]) for e in entries if counts[e[0], e[1]] > 1 or any(g[1] > state["batches"][e[2]]["number"] for g in state["gone"])}
            return self._facts.compacted(state, number, due) if due else None

        self._commit(change)

    def _table(self, state: dict) -> DataFrame:
        if state["instruments"] is None:
            return self.spark.createDataFrame([], "ticker string, instrument_type string, data_source string, currency string")
        return self.spark.read.parquet(f"{self.path}/instruments/{state['instruments']}")

    def facts(self, field: str | None = None, start=None, end=None, tickers: Tickers | None = None) -> DataFrame:
        """Stored rows. Only the partitions of a field and of a span of dates are opened, and of these the slots that hold the tickers."""
        state = self.log.latest()[1]
        lo, hi = (None if d is None else int(str(d)[:4]) for d in (start, end))
        entries = self._facts.entries(state, field, lo, hi)
        if tickers is not None and entries:
            names = self._names(tickers)
            rows = self._facts.rows(state, self._facts.holding(entries, names)).join(names, "ticker", "left_semi")
        else:
            rows = self._facts.rows(state, entries)
        rows = rows.drop("version")
        rows = rows if start is None else rows.where(F.col("obs_date") >= F.lit(start).cast("date"))
        return rows if end is None else rows.where(F.col("obs_date") <= F.lit(end).cast("date"))

    def instruments(self) -> DataFrame:
        return self._table(self.log.latest()[1])

    def reset(self) -> None:
        """Empties both tables."""
        self._commit(lambda state, number: self._with_instruments(state | {"facts": [], "batches": {}, "gone": []}, lambda table: table.limit(0)))

    # instruments

    def exists(self, ticker: str) -> bool:
        return bool(self.instruments().where(F.col("ticker") == ticker.upper()).take(1))

    def existence(self, tickers: Sequence[str], data_source: str | None = None) -> tuple[list[str], list[str], list[str]]:
        """The tickers that are there, those that are not, and those that come from another source."""
        wanted = list(dict.fromkeys(t.upper() for t in tickers))
        got = {r["ticker"]: r["data_source"] for r in self._among(self.instruments(), wanted).select("ticker", "data_source").collect()}
        other = [t for t in wanted if t in got and data_source is not None and got[t] != data_source.upper()]
        return [t for t in wanted if t in got and t not in other], [t for t in wanted if t not in got], other

    def tickers(self, attributes: Mapping[str, object] | None = None) -> list[str]:
        """Tickers by attribute: one of the values given for each attribute."""
        out = self.instruments()
        for name, values in (attributes or {}).items():
            if name not in out.columns:
                raise ValueError(f"{name} is no attribute")
            values = values if isinstance(values, (list, tuple, set)) else [values]
            out = out.where(F.col(name).isin([v if name in DATES_FREE or not isinstance(v, str) else text.attribute_py(v) for v in values]))
        return [r[0] for r in out.select("ticker").orderBy("ticker").collect()]

    def attributes(self, tickers: Tickers, names: Sequence[str]) -> DataFrame:
        return self._among(self.instruments(), tickers).select("ticker", *names)

    def _checked(self, rows: DataFrame) -> DataFrame:
        bad = rows.where(~F.col("instrument_type").isin(*INSTRUMENT_TYPES) | ~F.col("data_source").isin(*DATA_SOURCES)).take(1) if {"instrument_type", "data_source"} <= set(rows.columns) else []
        if bad:
            raise ValueError(f"unknown instrument type or data source: {bad[0]}")
        return rows

    def add(self, rows: DataFrame, on_conflict: str = "ignore") -> None:
        """New instruments. Those that are there stay (ignore), are replaced (replace), or are replaced without their facts (delete)."""
        if on_conflict not in ("ignore", "replace", "delete"):
            raise ValueError("on_conflict is ignore, replace or delete")
        rows = self._checked(rows.withColumn("ticker", F.upper("ticker"))).distinct()
        marks = [f"last_{f}_refresh" for f in FIELDS]
        rows = rows.withColumns({m: F.lit(None).cast("date") for m in marks if m not in rows.columns})
        if rows.groupBy("ticker").count().where("count > 1").take(1):
            raise ValueError("a ticker has different attributes in two rows")

        def merged(old: DataFrame) -> DataFrame:
            if on_conflict == "ignore":
                return old.unionByName(rows.join(old.select("ticker"), "ticker", "left_anti"), allowMissingColumns=True)
            return old.join(rows.select("ticker"), "ticker", "left_anti").unionByName(rows, allowMissingColumns=True)

        if on_conflict == "delete":
            self._delete(rows, merged)
        else:
            self._change_instruments(merged)

    def update_attributes(self, changes: DataFrame) -> None:
        """Sets the attributes that ``changes`` (ticker, ...) has; unknown tickers are an error."""
        if changes.join(self.instruments(), "ticker", "left_anti").take(1):
            raise ValueError("attributes of an unknown ticker")
        cols = [c for c in changes.columns if c != "ticker"]
        new = changes.select("ticker", F.struct(*cols).alias("given"))

        def changed(old: DataFrame) -> DataFrame:
            kept = [F.coalesce(F.col("given")[c], F.col(c)).alias(c) if c in cols else F.col(c) for c in old.columns]
            return old.join(new, "ticker", "left").select(*kept, *[F.col("given")[c].alias(c) for c in cols if c not in old.columns])

        self._change_instruments(changed)

    def delete(self, tickers: Tickers) -> None:
        """Instruments and their facts."""
        names = self._names(tickers)
        self._delete(names, lambda table: table.join(names, "ticker", "left_anti"))

    @staticmethod
    def _spans(names: DataFrame, fields: Sequence[str], lo=None, hi=None) -> DataFrame:
        ends = [F.lit(x or y).cast("date").alias(n) for x, y, n in ((lo, "0001-01-01", "lo"), (hi, "9999-12-31", "hi"))]
        return names.select(F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), "ticker", *ends)

    def _delete(self, names: DataFrame, instruments: Callable[[DataFrame], DataFrame]) -> None:
        gone = self._facts.write_spans(self._spans(names, FIELDS))
        self._commit(lambda state, number: self._with_instruments(self._facts.tidy(state | {"gone": [*state["gone"], [gone, number, True]]}), instruments))

    # facts

    def upsert(self, rows: DataFrame, replace: bool | str = False, source: str = "EXCEL", created: dt.date | None = None, order: str | None = None, token: tuple[str, int] | None = None) -> None:
        """Adds (obs_date, ticker, field, value). Stored rows stay and only new dates are added (False), stored rows of the same date, ticker
        and field give way ("exact"), or all that is stored in each ticker's and field's span of dates does (True).

        Rows may repeat, but not with different values, unless ``order`` names a column of whole numbers: then the row of the greatest (of equal ones
        the greater value) counts, here and among all that is stored with an order; what has none gives way to what has one. Nothing is written
        but the new rows and spans. A ``token`` (name, number) that is not above the last one of its name has been written before and does nothing.
        """
        key = [F.col("obs_date"), F.upper("ticker").alias("ticker"), F.col("field")]
        if order is None:
            value = F.when(F.min("value") == F.max("value"), F.max("value")).otherwise(F.raise_error(F.lit("a fact repeats with another value")).cast("double"))
            version = F.lit(None).cast("long")
        else:
            value, version = F.max_by("value", F.struct(order, "value")), F.max(F.col(order).cast("long"))
        new = rows.where("value is not null").groupBy(*key).agg(value.alias("value"), version.alias("version"))
        kinds = self.instruments()
        if "instrument_type" in kinds.columns:
            barred = [(F.col("field") == f) & F.col("instrument_type").isin(*t) for f, t in WITHOUT_FIELD.items()]
            new = new.join(kinds.select("ticker", "instrument_type"), "ticker", "left").where(~F.coalesce(barred[0] | barred[1] | barred[2], F.lit(False)))
        new = new.select("obs_date", "ticker", "value", F.lit(source).alias("source"), F.lit(created or dt.date.today()).alias("created_at"), "version", "field")
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        new.write.parquet(staged)  # the source is asked once
        new = self.spark.read.schema(FACT_SCHEMA).parquet(staged)
        total = new.count()
        batch, entries = self._facts.write(new, total) if total else (None, [])
        gone = None
        if replace is True and total:
            gone = self._facts.write_spans(new.groupBy("field", "ticker").agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi")))
        self._drop(staged)

        def change(state: dict, number: int) -> dict | None:
            streams = state["streams"]
            if token is not None:
                if streams.get(token[0], -1) >= token[1]:
                    return None
                streams = streams | {token[0]: token[1]}
            out = state | {"streams": streams}
            if total:
                out = self._facts.added(out, number, batch, entries, keep=replace is False and order is None, versioned=order is not None)
            if gone is not None and self._facts.entries(state):
                out["gone"] = [*state["gone"], [gone, number, False]]
            return out

        self._commit(change)
        counts = Counter((e[0], e[1]) for e in self.log.latest()[1]["facts"])
        if total and max(counts[e[0], e[1]] for e in entries) > self.most_batches:
            due = {(e[0], e[1]) for e in entries if counts[e[0], e[1]] > self.most_batches}
            self._commit(lambda state, number: self._facts.compacted(state, number, due))

    def _cut(self, spans: Callable[[dict], DataFrame]) -> None:
        """Deletes the rows in spans that are found in the state that the commit builds on."""

        def change(state: dict, number: int) -> dict | None:
            if not state["facts"]:
                return None
            return state | {"gone": [*state["gone"], [self._facts.write_spans(spans(state)), number, True]]}

        self._commit(change)

    def delete_facts(self, field: str, tickers: Tickers, start=None, end=None, dates: Sequence[str] | None = None) -> None:
        """Rows of a field by tickers and a span of dates, or listed dates within it."""
        spans = self._spans(self._names(tickers), [field], start, end)
        if dates is not None:
            listed = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
            spans = spans.withColumn("day", listed).where(F.col("day").between(F.col("lo"), F.col("hi"))).select("field", "ticker", F.col("day").alias("lo"), F.col("day").alias("hi"))
        self._cut(lambda state: spans)

    def delete_unsettled(self, tickers: Tickers) -> None:
        """Rows that were captured on their own date, before the close."""
        day = F.col("obs_date")
        self._cut(lambda state: self._among(self._facts.rows(state, state["facts"]), tickers).where(day == F.col("created_at")).select("field", "ticker", day.alias("lo"), day.alias("hi")))

    def dates(self, field: str | None = None, tickers: Tickers | None = None) -> DataFrame:
        """field, ticker, first and last date of what is stored, from the batches' summaries."""
        state = self.log.latest()[1]
        return self._facts.dates(state, self._facts.entries(state, field), None if tickers is None else self._names(tickers))

    def observed(self) -> DataFrame:
        """Per ticker: oldest and latest date, latest date with a close, first ex-dividend date, whether it pays dividends. From the batches' summaries."""
        quoted = F.col("field") != "dividend"
        return self.dates().groupBy("ticker").agg(
            F.min(F.when(quoted, F.col("first"))).alias("oldest_obs_date"),
            F.max(F.when(quoted, F.col("last"))).alias("latest_obs_date"),
            F.max(F.when(F.col("field") == "close", F.col("last"))).alias("latest_obs_date_with_values"),
            F.min(F.when(~quoted, F.col("first"))).alias("first_ex_div_date"),
            (F.count(F.when(~quoted, 1)) > 0).alias("has_dividend_history"),
        )

    def refresh_dates(self) -> None:
        """Writes ``observed`` into the instruments."""
        own = self.observed()
        drop = [c for c in own.columns if c != "ticker"]
        self._change_instruments(lambda table: table.drop(*drop).join(own, "ticker", "left"))

    def latest_dates(self, field: str, tickers: Tickers | None = None) -> DataFrame:
        return self.dates(field, tickers).join(self.instruments().select("ticker"), "ticker", "left_semi").select("ticker", F.col("last").alias("latest"))

    def eligible_start(self, tickers: Tickers, fields: Sequence[str] = ("close",)) -> dt.date | None:
        """Oldest of the latest dates; None if any ticker has no row of a field."""
        names, out = self._names(tickers), []
        wanted = names.count()
        for field in fields:
            r = self.latest_dates(field, names).agg(F.min("latest"), F.count("*")).first()
            if r[1] < wanted:
                return None
            out.append(r[0])
        return min(out)

    def since(self, field: str, tickers: Tickers, first: dt.date, rows: int) -> dt.date:
        """The begin of the last year from which on every ticker has ``rows`` rows before the year of ``first``, or all it ever had. From the summaries."""
        state = self.log.latest()[1]
        first = dt.date.fromisoformat(str(first)[:10])
        year = self._facts.year_of(state, self._facts.entries(state, field, hi=first.year - 1), self._names(tickers), rows) if rows > 0 else None
        return dt.date(first.year if year is None else year, 1, 1)

    def stale(self, field: str, as_of: dt.date, tickers: Tickers | None = None) -> DataFrame:
        """Tickers that may have the field and were never refreshed or not since ``as_of``."""
        kinds = self.instruments()
        if field in WITHOUT_FIELD and "instrument_type" in kinds.columns:
            kinds = kinds.where(~F.col("instrument_type").isin(*WITHOUT_FIELD[field]))
        kinds = kinds if tickers is None else self._among(kinds, tickers)
        mark = f"last_{field}_refresh"
        if mark in kinds.columns:
            kinds = kinds.where(F.col(mark).isNull() | (F.col(mark) <= F.lit(as_of)))
        return kinds.select("ticker").distinct()

    def active(self, today: dt.date, most_days: int = 14) -> DataFrame:
        """Tickers whose latest close is at most so many days old; those without one count as active."""
        return self.instruments().select("ticker").join(self.latest_dates("close"), "ticker", "left").where(F.col("latest").isNull() | (F.datediff(F.lit(today), "latest") <= most_days)).select("ticker")

    def record_refresh(self, tickers: Tickers, field: str | Sequence[str], on: dt.date) -> None:
        marks = [f"last_{f}_refresh" for f in ([field] if isinstance(field, str) else field)]
        asked = self._names(tickers).withColumn("asked", F.lit(on))

        def marked(old: DataFrame) -> DataFrame:
            own = {m: F.col(m).cast("date") if m in old.columns else F.lit(None).cast("date") for m in marks}
            return old.join(asked, "ticker", "left").withColumns({m: F.coalesce("asked", own[m]) for m in marks}).drop("asked")

        self._change_instruments(marked)

    def refresh(self, source: Source, tickers: Tickers, replace: bool = True, today: dt.date | None = None) -> None:
        """Incremental batch: facts from the least latest date on, then the dates of the instruments. A table of tickers is handed to the source as it is."""
        names = self._requested(tickers)
        asked = names if isinstance(tickers, DataFrame) else list(dict.fromkeys(t.upper() for t in ([tickers] if isinstance(tickers, str) else tickers)))
        start = self.eligible_start(names)
        self.upsert(source.facts(self.spark, asked, start), replace=replace, created=today)
        self.record_refresh(names, FIELDS, today or dt.date.today())
        self.refresh_dates()

    def ingest(self, source: Source, tickers: Tickers, on_conflict: str = "ignore", refresh: bool = True, today: dt.date | None = None) -> None:
        """New tickers of a source: their instruments and, if wanted, their facts."""
        self.add(source.instruments(self.spark, tickers), on_conflict)
        if refresh:
            self.refresh(source, tickers, today=today)

    # scans

    def _requested(self, tickers: Tickers) -> DataFrame:
        """The requested tickers as a table, after the checks."""
        if isinstance(tickers, DataFrame):
            n, each = tickers.agg(F.count("*"), F.count_distinct(F.upper("ticker"))).first()
        else:
            wanted = [t.upper() for t in ([tickers] if isinstance(tickers, str) else tickers)]
            n, each = len(wanted), len(set(wanted))
        if not n:
            raise TypeError("no tickers are given")
        if each < n:
            raise ValueError("tickers repeat")
        names = self._names(tickers)
        missing = [r[0] for r in names.join(self.instruments(), "ticker", "left_anti").orderBy("ticker").limit(20).collect()]
        if missing:
            raise ValueError(f"unknown tickers {missing}")
        return names

    def scan(self, field: str, tickers: Tickers, start=None, end=None, currency: str | None = None, ffill_na: bool = False, bfill_na: bool = False, drop_na: bool = False, on_duplicates: str = "error") -> DataFrame:
        """Dense panel of a field: every requested ticker on every date on which one has a value.

        Bounds that are missing are those of the data. Volumes are never converted.
        """
        if field not in FIELDS:
            raise ValueError(f"{field} is no field")
        wanted = self._requested(tickers)
        rows = self.facts(field, start, end, wanted)
        n = F.count("*")
        value = F.avg("value") if on_duplicates == "mean" else F.when(n > 1, F.raise_error(F.lit("a fact repeats")).cast("double")).otherwise(F.first("value"))
        cells = rows.groupBy("obs_date", "ticker").agg(value.alias("value"))
        panel = dense(cells, tickers=wanted)
        panel = clean.drop_empty_dates(panel)
        if currency is not None and field != "volume":
            panel = convert(panel, self.instruments(), self._fx(start, end), currency)
        return clean.fill(panel, ffill_na, bfill_na, drop_na)

    def _fx(self, start=None, end=None) -> DataFrame:
        """Currency closes for the dates of a span: each one's last before it too."""
        names = self.dates("close").where(F.col("ticker").endswith(".FX")).select("ticker")
        begin = None if start is None else self.since("close", names, start, 1)
        return self.facts("close", begin, end, names).select("obs_date", "ticker", "value")

    def open(self, tickers, **how) -> DataFrame:
        return self.scan("open", tickers, **how)

    def high(self, tickers, **how) -> DataFrame:
        return self.scan("high", tickers, **how)

    def low(self, tickers, **how) -> DataFrame:
        return self.scan("low", tickers, **how)

    def close(self, tickers, **how) -> DataFrame:
        return self.scan("close", tickers, **how)

    def volume(self, tickers, **how) -> DataFrame:
        return self.scan("volume", tickers, **{k: v for k, v in how.items() if k != "currency"})

    def dividends(self, tickers, start=None, end=None, currency: str | None = None) -> DataFrame:
        return self.scan("dividend", tickers, start=start, end=end, currency=currency)

    def liquidity(self, tickers, **how) -> DataFrame:
        """Close times the volume as of the close's dates."""
        fills = {k: how.pop(k) for k in ("ffill_na", "bfill_na", "drop_na") if k in how}
        close = self.close(tickers, **how)
        volume = asof.on_calendar(self.volume(tickers, **how), close).withColumnRenamed("value", "__v")
        out = close.join(volume, ["obs_date", "ticker"], "left").withColumn("value", F.col("value") * F.col("__v")).drop("__v")
        return clean.fill(out, **fills)

    def total_return(self, tickers, start=None, end=None, withholding_tax: float = 0.0, currency: str | None = None, payers_only: bool = False, **fills) -> DataFrame:
        """Total return prices, computed in each ticker's own currency and converted once.

        With ``payers_only`` types that can't pay dividends keep their price.
        """
        close = self.close(tickers, start=start, end=end)
        paid = self.facts("dividend", start, end, tickers).select("obs_date", "ticker", "value")
        if payers_only:
            paid = paid.join(self.instruments().where(~F.col("instrument_type").isin(*WITHOUT_FIELD["dividend"])).select("ticker"), "ticker", "left_semi")
        out = total_return(close, paid, withholding_tax)
        if currency is not None:
            out = convert(out, self.instruments(), self._fx(start, end), currency)
        return clean.fill(out, **fills)

    def get(self, data_type: str, tickers, **how) -> DataFrame:
        """One of open, high, low, close, total_return, volume, liquidity."""
        if data_type not in ("open", "high", "low", "close", "total_return", "volume", "liquidity"):
            raise ValueError(f"{data_type} is no data type")
        return getattr(self, data_type)(tickers, **how)


def open_store(path: str, app: str = "panelith", config: Mapping[str, str] | None = None, **how) -> PanelStore:
    """The store under a path with a session of its own making, or the one there is; a new store has both tables, empty."""
    builder = SparkSession.builder.appName(app)
    for key, value in (config or {}).items():
        builder = builder.config(key, value)
    store = PanelStore(builder.getOrCreate(), path, **how)
    if not store.log.numbers():
        store.reset()
    return store


class DataGetter:
    """Metrics of stored data on an observation calendar: frequency filter, null policy, metric, as-of.

    ``tickers`` is a list, or a table (obs_date, ticker) of one list for each of some dates: a list holds until the next one's date. A metric is computed
    once per ticker, over all its rows, and cut to the dates on which the ticker stands in the list. With a window only the years are opened that the
    calendar's dates and the rows before them need.

    With ``keep`` the scanned panel is written to the shared folder and read again by the next metric, as long as it covers what that asks for and the
    store has not changed since; ``calendar``, ``window`` and ``freq`` may be set anew in between.
    """

    def __init__(self, store: PanelStore, tickers: Tickers, calendar: DataFrame, data_type: str = "close", freq: int | str | None = None, policy: str | None = None, window: int | None = None, keep: bool = False, **how):
        if not isinstance(tickers, DataFrame) and not tickers:
            raise ValueError("tickers are needed")
        if window is not None and window <= 0:
            raise ValueError("the window is positive")
        self.lists = tickers.select("obs_date", F.upper("ticker").alias("ticker")).distinct() if isinstance(tickers, DataFrame) and "obs_date" in tickers.columns else None
        self.tickers = self.lists.select("ticker").distinct() if self.lists is not None else tickers if isinstance(tickers, DataFrame) else list(tickers)
        self.store, self.calendar, self.data_type, self.freq, self.policy, self.window, self.keep, self.how = store, calendar, data_type, freq, policy, window, keep, how
        self._kept: tuple | None = None

    def _skip(self) -> bool:
        return self.policy == "skip"

    def _scanned(self, rows: int | None) -> DataFrame:
        """The data, from where ``rows`` rows before the calendar's first date begin; all for None."""
        how = dict(self.how)
        if rows is not None and "start" not in how:
            lo, hi = self.calendar.agg(F.min("obs_date"), F.max("obs_date")).first()
            if lo is not None:
                how |= {"start": StoredPanel(self.store, self.tickers, self.data_type).since(lo, rows, self.freq), "end": how.get("end", hi)}
        if not self.keep:
            return self.store.get(self.data_type, self.tickers, **how)
        state, lo, hi = (self.store.log.latest()[0], self.data_type), how.pop("start", None), how.pop("end", None)
        text_of = lambda x: None if x is None else str(x)[:10]
        lo, hi = text_of(lo), text_of(hi)
        if self._kept is not None:
            was, a, b, panel = self._kept
            if was == state and (a is None or lo is not None and a <= lo) and (b is None or hi is not None and hi <= b):
                panel = panel if lo is None else panel.where(F.col("obs_date") >= F.lit(lo).cast("date"))
                return panel if hi is None else panel.where(F.col("obs_date") <= F.lit(hi).cast("date"))
        panel = materialized(self.store.get(self.data_type, self.tickers, start=lo, end=hi, **how), "getter")
        self._kept = (state, lo, hi, panel)
        return panel

    def data(self, return_lag: int | None = None, rows: int | None = None) -> DataFrame:
        from ..operators.cross import frequency_filter
        from ..operators.rolling import pct_change_raw

        panel = frequency_filter(self._scanned(rows), self.freq)
        panel = panel if self._skip() else clean.null_policy(panel, self.policy)
        return pct_change_raw(panel, return_lag) if return_lag else panel

    def _on(self, panel: DataFrame, ffill_values: bool) -> DataFrame:
        out = asof.on_calendar(clean.ffill(panel) if ffill_values else panel, self.calendar)
        if self.lists is None:
            return out
        # the list of a date is the last one up to it
        days = asof.calendar_map(self.calendar, self.lists).where("as_of is not null")
        inside = days.join(self.lists.withColumnRenamed("obs_date", "as_of"), "as_of").select("obs_date", "ticker")
        return out.join(inside, ["obs_date", "ticker"], "left_semi")

    def _rows(self, lag: int = 1) -> int | None:
        """Rows that a metric over the window looks back, with one more for its first return."""
        return None if self.window is None else self.window + lag + 1

    def holding_period_return(self, ending_lag: int = 0, ffill_values: bool = False) -> DataFrame:
        from ..operators.rolling import holding_period_return

        return self._on(holding_period_return(self.data(rows=self._rows(ending_lag)), self.window, ending_lag, self._skip()), ffill_values)

    def volatility(self, return_lag: int = 1, ffill_values: bool = False) -> DataFrame:
        from ..operators.cross import annualization_factor
        from ..operators.rolling import realized_volatility

        return self._on(realized_volatility(self.data(rows=self._rows(return_lag)), return_lag, self.window, self._skip(), annualization_factor(self.freq) / return_lag), ffill_values)

    def beta(self, beta_ticker: str, return_lag: int = 1, ffill_values: bool = False) -> DataFrame:
        from ..operators.rolling import realized_beta

        if self.lists is not None and not self.lists.where(F.col("ticker") == beta_ticker.upper()).take(1):
            raise ValueError("the beta's ticker stands in no list")
        return self._on(realized_beta(self.data(rows=self._rows(return_lag)), beta_ticker, return_lag, self.window, self._skip()), ffill_values)
