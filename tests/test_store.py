import datetime as dt

import pytest

from panelith.functions import calendar, text
from panelith.plans import strategy
from panelith.sources import readers
from panelith.sources.store import DataGetter, PanelStore
from pyspark.sql import functions as F

D = dt.date


@pytest.fixture
def filled(spark, tmp_path):
    s = PanelStore(spark, str(tmp_path / "store"))
    s.add(spark.createDataFrame([("aa", "STOCK", "EXCEL", "USD", "TECH"), ("BB", "INDEX", "EXCEL", "EUR", "TECH"), ("USD_EUR.FX", "FX", "EXCEL", "USD", "FX")], "ticker string, instrument_type string, data_source string, currency string, sector string"))
    rows = [(D(2024, 1, k), t, f, float(v)) for k in range(1, 6) for t, f, v in (("AA", "close", 100 + k), ("BB", "close", 50 + k), ("AA", "volume", 10 * k), ("BB", "volume", 1), ("USD_EUR.FX", "close", 1 + k / 10))]
    rows += [(D(2024, 1, 3), "AA", "dividend", 1.0), (D(2024, 1, 3), "BB", "dividend", 1.0)]
    s.upsert(spark.createDataFrame(rows, "obs_date date, ticker string, field string, value double"), created=D(2024, 1, 5))
    return s


def values(df):
    return {(r["ticker"], r["obs_date"].day): r["value"] for r in df.collect()}


def test_scans(filled, spark):
    assert values(filled.close(["AA", "BB"], start="2024-01-04")) == {("AA", 4): 104, ("AA", 5): 105, ("BB", 4): 54, ("BB", 5): 55}
    assert values(filled.close("BB", currency="usd", end="2024-01-01")) == {("BB", 1): pytest.approx(51 * 1.1)}
    # indices have no volume and pay no dividends
    assert set(values(filled.volume(["AA", "BB"])).values()) == {10, 20, 30, 40, 50, None}
    assert values(filled.total_return("AA", withholding_tax=0.2))[("AA", 3)] == pytest.approx(101 * (102 / 101) * (103 / 102 + 0.8 / 102))
    assert values(filled.liquidity("AA"))[("AA", 2)] == 102 * 20
    with pytest.raises(ValueError):
        filled.close(["NOPE"])
    with pytest.raises(TypeError):
        filled.close([])
    with pytest.raises(ValueError):
        filled.close(["AA", "aa"])
    with pytest.raises(ValueError):
        filled.get("colour", ["AA"])


def test_writes(filled, spark):
    new = spark.createDataFrame([(D(2024, 1, 5), "AA", "close", 999.0), (D(2024, 1, 6), "AA", "close", 106.0)], "obs_date date, ticker string, field string, value double")
    filled.upsert(new)
    assert values(filled.close("AA"))[("AA", 5)] == 105 and values(filled.close("AA"))[("AA", 6)] == 106
    filled.upsert(new, replace=True, created=D(2024, 1, 6))
    assert values(filled.close("AA"))[("AA", 5)] == 999
    filled.delete_unsettled(["AA"])
    assert ("AA", 6) not in values(filled.close("AA"))
    filled.delete_facts("close", ["AA"], start="2024-01-03", end="2024-01-04")
    assert sorted(k[1] for k in values(filled.close("AA"))) == [1, 2, 5]
    filled.delete(["BB"])
    assert filled.existence(["AA", "BB"]) == (["AA"], ["BB"], []) and not filled.exists("bb")
    filled.reset()
    assert filled.facts().count() == 0 and filled.tickers() == []


def test_instruments(filled, spark):
    assert filled.tickers({"sector": ["tech"], "instrument_type": "index"}) == ["BB"]
    assert filled.existence(["aa"], "YAHOO") == ([], [], ["AA"])
    filled.update_attributes(spark.createDataFrame([("AA", "ENERGY")], "ticker string, sector string"))
    assert filled.tickers({"sector": "ENERGY"}) == ["AA"]
    filled.refresh_dates()
    r = {x["ticker"]: x for x in filled.instruments().collect()}
    assert r["AA"]["latest_obs_date"] == D(2024, 1, 5) and r["AA"]["has_dividend_history"] and r["AA"]["first_ex_div_date"] == D(2024, 1, 3)
    assert filled.eligible_start(["AA", "BB"]) == D(2024, 1, 5) and filled.eligible_start(["AA"], ["split"]) is None
    filled.record_refresh(["AA"], "close", D(2024, 1, 5))
    assert [x[0] for x in filled.stale("close", D(2024, 1, 4)).orderBy("ticker").collect()] == ["BB", "USD_EUR.FX"]
    assert filled.active(D(2024, 3, 1)).count() == 0
    with pytest.raises(ValueError):
        filled.add(spark.createDataFrame([("X", "THING", "EXCEL", "USD")], "ticker string, instrument_type string, data_source string, currency string"))
    with pytest.raises(ValueError):
        filled.update_attributes(spark.createDataFrame([("ZZ", "ENERGY")], "ticker string, sector string"))


def test_refresh_and_getter(filled, spark):
    facts = spark.createDataFrame([(D(2024, 1, k), "AA", "close", 200.0 + k) for k in range(4, 9)], "obs_date date, ticker string, field string, value double")
    filled.refresh(readers.FrameSource(facts, filled.instruments()), ["AA"], today=D(2024, 1, 8))
    assert values(filled.close("AA"))[("AA", 8)] == 208 and values(filled.close("AA"))[("AA", 4)] == 104
    cal = spark.createDataFrame([(D(2024, 1, 7),), (D(2024, 1, 20),)], "obs_date date")
    got = [r["value"] for r in DataGetter(filled, ["AA"], cal, window=1).holding_period_return().orderBy("obs_date").collect()]
    assert got == pytest.approx([207 / 206 - 1, 208 / 207 - 1])
    with pytest.raises(ValueError):
        DataGetter(filled, [], cal)


def test_workbook_and_reports(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "underlying.csv").write_text("ticker,sector,instrument_type\naa,high tech,STOCK\nbb,,STOCK\n")
    (tmp_path / "close_price.csv").write_text("date,aa,bb\n2024-01-01,1,\n2024-01-02,2,5\n")
    (tmp_path / "dividend.csv").write_text("date,aa,bb\n2024-01-02,0,0.5\n")
    book = readers.WorkbookSource(folder)
    assert sorted((r["ticker"], r["field"], r["value"]) for r in book.facts(spark).collect()) == [("AA", "close", 1.0), ("AA", "close", 2.0), ("BB", "close", 5.0), ("BB", "dividend", 0.5)]
    assert {r["ticker"]: r["sector"] for r in book.instruments(spark).collect()} == {"AA": "HIGH_TECH", "BB": "NA"}
    (tmp_path / "close_price.csv").write_text("date,aa\n2024-01-01,1\n2024-01-01,2\n")
    with pytest.raises(ValueError):
        book.facts(spark)
    readers.write_report({"a name that is longer than thirty-one characters": spark.range(3)}, folder + "/out")
    assert readers.read_sheet(spark, folder + "/out", "a name that is longer than thirty-one characters").count() == 3
    assert readers.list_tables(spark, folder, ".csv") == ["close_price.csv", "dividend.csv", "underlying.csv"]


def test_text_and_calendar(spark):
    r = spark.range(1).select(
        text.add_suffix(F.lit("abb ss")).alias("a"), text.add_suffix(F.lit("spx index")).alias("b"), text.remove_suffix(F.lit("ABB SS EQUITY")).alias("c"),
        text.fx_to_quote(F.lit("SEK_USD.FX")).alias("d"), text.fx_to_quote(F.lit("SEK_EUR.FX")).alias("e"), text.fx_to_terminal(F.lit("SEK_EUR.FX")).alias("f"),
        text.split_list(F.lit(" a,  b   c ")).alias("g"), text.is_number(F.lit("1e3")).alias("h"), text.expiry_of(F.lit("EXPIRY 2024-03-15")).alias("i"), text.expiry_of(F.lit("none")).alias("j"),
    ).first()
    assert tuple(r) == ("ABB SS EQUITY", "SPX INDEX", "ABB SS", "SEK=X", "EURSEK=X", "EURSEK BGN CURNCY", ["a", "b c"], True, D(2024, 3, 15), None)
    import pandas as pd

    days = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=k),) for k in range(14)], "d date")
    for n in (-7, -5, -2, -1, 1, 2, 5, 8):
        for x in days.select("d", calendar.business_shift(F.col("d"), n).alias("s")).collect():
            assert x["s"] == (pd.Timestamp(x["d"]) + pd.offsets.BDay(n)).date(), (x, n)
    assert [r[0] for r in calendar.date_range(spark, start="2024-01-15", periods=3, freq="M").collect()] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31)]
    assert text.snake("ClosePrice") == "close_price"


def test_stream_feeds_the_store(filled, spark, tmp_path):
    from panelith.streaming.upsert import upsert_stream

    src = tmp_path / "in"
    spark.createDataFrame([(D(2024, 1, 9), "AA", "close", 109.0)], "obs_date date, ticker string, field string, value double").write.parquet(str(src))
    q = upsert_stream(spark.readStream.schema("obs_date date, ticker string, field string, value double").parquet(str(src)), filled, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert values(filled.close("AA"))[("AA", 9)] == 109


FACTS = "obs_date date, ticker string, field string, value double"


def test_sparse_micro_batches_keep_what_lies_between(filled, spark, tmp_path):
    from panelith.streaming.upsert import upsert_stream

    filled.upsert(spark.createDataFrame([(D(2024, 2, k), "AA", "close", 300.0 + k) for k in range(1, 21)], FACTS))
    src = str(tmp_path / "in")
    spark.createDataFrame([(D(2024, 2, 2), "AA", "close", 1.0), (D(2024, 2, 19), "AA", "close", 2.0)], FACTS).write.parquet(src)
    upsert_stream(spark.readStream.schema(FACTS).parquet(src), filled, str(tmp_path / "cp")).awaitTermination(60)
    got = values(filled.close("AA", start="2024-02-01"))
    assert len(got) == 20 and got["AA", 2] == 1 and got["AA", 19] == 2 and got["AA", 10] == 310


def test_writes_leave_what_is_stored_alone(filled, spark):
    def held():
        return {(*e[:3], *e[3]) for e in filled.log.latest()[1]["facts"]}

    before = held()
    filled.upsert(spark.createDataFrame([(D(2025, 1, 2), "AA", "close", 5.0)], FACTS))
    after = held()
    assert before < after and len(after - before) == 1
    filled.delete_facts("volume", ["AA"])
    assert held() == after and len(filled.log.latest()[1]["gone"]) == 1
    filled.vacuum()
    assert values(filled.close("AA", start="2025-01-01")) == {("AA", 2): 5.0} and filled.exists("AA") and filled.facts("volume").count() == 0


def test_facts_that_contradict_each_other(filled, spark):
    filled.upsert(spark.createDataFrame([(D(2024, 3, 1), "AA", "close", 5.0), (D(2024, 3, 1), "aa", "close", 5.0)], FACTS))
    assert values(filled.close("AA", start="2024-03-01")) == {("AA", 1): 5.0}
    with pytest.raises(Exception, match="repeats"):
        filled.upsert(spark.createDataFrame([(D(2024, 3, 2), "AA", "close", 5.0), (D(2024, 3, 2), "AA", "close", 6.0)], FACTS))
    with pytest.raises(ValueError):
        filled.add(spark.createDataFrame([("X", "STOCK", "EXCEL", "USD"), ("x", "ETF", "EXCEL", "USD")], "ticker string, instrument_type string, data_source string, currency string"))


def test_strategy_end_to_end(filled, spark, make_panel):
    p = make_panel({"AA": [100 + k for k in range(30)], "BB": [100 - k for k in range(30)]})
    cal = p.where("day(obs_date) in (5, 15)").select("obs_date").distinct()
    u = strategy.Universe(["AA", "BB"], cal)
    s = strategy.Strategy(strategy.SmaCross(u.eligibility(), p, 2, 1), lambda x: strategy.equal_weight(x), p, weight_lag=1)
    out = s.back_test().orderBy("obs_date").collect()
    assert out[0]["value"] == 100 and len(out) > 20


def paths(df):
    return {f.split("/facts/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def size_of(spark, store, batch):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/facts/batch={batch}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


@pytest.fixture
def wide(spark, tmp_path):
    """200 tickers over two years, in slots of about 1,000 rows."""
    s = PanelStore(spark, str(tmp_path / "wide"), slot_rows=1000, most_batches=3)
    names = spark.range(200).select(F.format_string("T%03d", "id").alias("ticker"))
    s.add(names.select("ticker", F.lit("STOCK").alias("instrument_type"), F.lit("EXCEL").alias("data_source"), F.lit("USD").alias("currency")))
    days = spark.range(20).select(F.date_add(F.lit(D(2023, 12, 22)), F.col("id").cast("int")).alias("obs_date"))
    s.upsert(names.crossJoin(days).select("obs_date", "ticker", F.lit("close").alias("field"), (F.dayofyear("obs_date") + F.substring("ticker", 2, 3).cast("int")).cast("double").alias("value")), created=D(2024, 2, 1))
    return s


def test_a_scan_of_few_tickers_opens_few_slots(wide, spark):
    all_slots = paths(wide.facts("close"))
    few = paths(wide.facts("close", tickers=["T007", "t008"]))
    assert len(all_slots) >= 4 and len(few) <= 2 and few <= all_slots
    asked = spark.createDataFrame([("T007",), ("t008",)], "ticker string")
    got = wide.close(asked, start="2024-01-01")
    assert values(got) == values(wide.close(["T007", "T008"], start="2024-01-01")) and len(values(got)) == 20
    assert paths(wide.facts("close", "2024-01-01")) < all_slots
    with pytest.raises(ValueError):
        wide.close(asked.unionAll(asked))
    with pytest.raises(ValueError):
        wide.close(spark.createDataFrame([("NOPE",)], "ticker string"))


def test_many_tickers_are_a_join(wide, spark):
    began = dt.datetime.now()
    many = [f"T{k:03d}" for k in range(200)] + [f"X{k}" for k in range(100_000)]
    there, missing, _ = wide.existence(many)
    assert len(there) == 200 and len(missing) == 100_000
    assert wide.facts("close", tickers=many).count() == 4000
    assert (dt.datetime.now() - began).seconds < 60


def test_small_writes_stay_small_and_are_folded(wide, spark):
    (first,) = wide.log.latest()[1]["batches"]
    want = {(r["ticker"], r["obs_date"]): r["value"] for r in wide.facts("close").collect()}
    for k in range(5):
        day = D(2024, 1, 2 + k)
        rows = [(day, "T005", "close", float(k)), (D(2024, 3, 1 + k), "T005", "close", 9.0)]
        wide.upsert(spark.createDataFrame(rows, FACTS), replace="exact")
        want |= {(t, d): v for d, t, _, v in rows}
    state = wide.log.latest()[1]
    assert all(sum(e[:2] == [f, y] for e in state["facts"]) <= 4 for f, y in (("close", 2023), ("close", 2024)))
    assert {(r["ticker"], r["obs_date"]): r["value"] for r in wide.facts("close").collect()} == want
    small = [b for b in state["batches"] if b != first and size_of(spark, wide, b) < 10_000]
    assert small and size_of(spark, wide, first) > 10_000
    wide.delete_facts("close", ["T005"], dates=["2024-03-05", "2024-01-02"])
    wide.compact()
    after = wide.log.latest()[1]
    assert not after["gone"] and len({e[2] for e in after["facts"] if e[1] == 2024}) == 1
    del want["T005", D(2024, 3, 5)], want["T005", D(2024, 1, 2)]
    wide.vacuum()
    assert {(r["ticker"], r["obs_date"]): r["value"] for r in wide.facts("close").collect()} == want
    assert wide.log.numbers() == [wide.log.latest()[0]]


def test_dates_come_from_summaries_and_equal_the_facts(wide, spark):
    def scanned():
        return {(r["ticker"], r["a"], r["b"]) for r in wide.facts("close").groupBy("ticker").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b")).collect()}

    def known():
        return {(r["ticker"], r["oldest_obs_date"], r["latest_obs_date"]) for r in wide.observed().collect()}

    assert known() == scanned() and not any("/facts/" in f for f in wide.observed().inputFiles())
    assert not any("/facts/" in f for f in wide.latest_dates("close").inputFiles())
    span = spark.createDataFrame([(D(2023, 12, 20), "T001", "close", 1.0), (D(2024, 1, 12), "T001", "close", 1.0), (D(2024, 5, 1), "T002", "close", 1.0)], FACTS)
    wide.upsert(span, replace=True)
    assert known() == scanned() and not any("/facts/" in f for f in wide.observed().inputFiles())
    wide.delete_facts("close", ["T002", "T003"], start="2024-01-05")
    wide.delete(["T004"])
    assert known() == scanned() and {t for t, _, _ in known()} == {f"T{k:03d}" for k in range(200)} - {"T004"}
    assert wide.latest_dates("close", ["T003"]).first()["latest"] == D(2024, 1, 4)
    wide.compact()
    assert known() == scanned() and not any("/facts/" in f for f in wide.observed().inputFiles())


def test_of_two_writers_both_commit(wide, spark):
    other, append = PanelStore(spark, wide.path), wide.log.append
    row = lambda t, v: spark.createDataFrame([(D(2024, 1, 3), t, "close", v)], FACTS)

    def late(number, state):
        wide.log.append = append
        other.upsert(row("T010", -1.0), replace="exact")
        other.upsert(row("T012", -5.0), replace="exact", created=D(2024, 1, 3))
        append(number, state)

    wide.log.append = late
    wide.upsert(row("T011", -2.0), replace="exact")
    got = {r["ticker"]: r["value"] for r in wide.facts("close", "2024-01-03", "2024-01-03", ["T010", "T011", "T012"]).collect()}
    assert got == {"T010": -1.0, "T011": -2.0, "T012": -5.0}

    def later(number, state):
        wide.log.append = append
        other.upsert(row("T013", -6.0), replace="exact", created=D(2024, 1, 3))
        append(number, state)

    wide.log.append = later
    wide.delete_unsettled(["T012", "T013"])  # what the other writer adds meanwhile is found too
    assert {r["ticker"] for r in wide.facts("close", "2024-01-03", "2024-01-03", ["T012", "T013"]).collect()} == set()


def test_kept_and_replaced_rows(filled, spark):
    row = lambda v, d=5: spark.createDataFrame([(D(2024, 1, d), "AA", "close", v)], FACTS)
    filled.upsert(row(1.0))  # stays 105
    filled.upsert(row(2.0, 9))
    filled.upsert(row(3.0, 9))  # stays 2
    assert values(filled.close("AA"))[("AA", 5)] == 105 and values(filled.close("AA"))[("AA", 9)] == 2
    filled.upsert(row(4.0, 9), replace="exact")
    filled.upsert(row(5.0, 9))
    assert values(filled.close("AA"))[("AA", 9)] == 4
    filled.delete_facts("close", ["AA"], dates=["2024-01-09"])
    assert ("AA", 9) not in values(filled.close("AA"))
    filled.upsert(row(6.0, 9))
    filled.compact("close")
    assert values(filled.close("AA"))[("AA", 9)] == 6
    assert len(values(filled.volume("AA"))) == 5


def test_streams_have_a_winner(filled, spark, tmp_path):
    from panelith.streaming.upsert import upsert_stream

    schema = FACTS + ", seen long"
    day = D(2024, 1, 3)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), filled, str(tmp_path / "check"), order="seen").awaitTermination()
        return values(filled.close("AA"))[("AA", 3)]

    assert feed([(day, "AA", "close", 7.0, 10), (day, "aa", "close", 9.0, 12), (day, "AA", "close", 8.0, 11)]) == 9.0
    assert feed([(day, "AA", "close", 1.0, 5)]) == 9.0  # late
    assert feed([(day, "AA", "close", 2.0, 13), (day, "AA", "close", 3.0, 13)]) == 3.0  # of equal ones the greater
    number = filled.log.latest()[0]
    assert filled.log.latest()[1]["streams"] == {str(tmp_path / "check"): 2}
    replayed = spark.createDataFrame([(day, "AA", "close", 99.0, 99)], schema)
    filled.upsert(replayed, replace="exact", order="seen", token=(str(tmp_path / "check"), 2))
    assert filled.log.latest()[0] == number and values(filled.close("AA"))[("AA", 3)] == 3.0
    # without an order the greater value counts
    spark.createDataFrame([(day, "AA", "close", 4.0, 1), (day, "AA", "close", 6.0, 2)], schema).write.parquet(str(tmp_path / "plain"))
    upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "plain")).drop("seen"), filled, str(tmp_path / "check2")).awaitTermination()
    filled.compact()
    assert values(filled.close("AA"))[("AA", 3)] == 3.0  # what has an order stays before what has none


def test_currencies_look_back_to_the_last_rate_before_the_span(spark, tmp_path):
    s = PanelStore(spark, str(tmp_path / "fx"))
    s.add(spark.createDataFrame([("BB", "STOCK", "EXCEL", "EUR")], "ticker string, instrument_type string, data_source string, currency string"))
    rows = [(D(2021, 5, 3), "USD_EUR.FX", "close", 2.0), (D(2020, 5, 3), "USD_EUR.FX", "close", 9.0), (D(2024, 1, 2), "BB", "close", 10.0), (D(2024, 1, 3), "BB", "close", 11.0), (D(2024, 1, 3), "USD_EUR.FX", "close", 3.0)]
    s.upsert(spark.createDataFrame(rows, FACTS))
    got = s.close("BB", start="2024-01-01", currency="usd")
    assert values(got) == {("BB", 2): 20.0, ("BB", 3): 33.0}
    assert {f.split("/year=")[1][:4] for f in got.inputFiles() if "/facts/" in f} == {"2021", "2024"}
