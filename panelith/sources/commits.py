"""Facts in committed batches: Parquet folders by field, year and slot, and a log that says which of them count.

A write adds a batch with its own rows only, however much is stored; what it deletes or replaces is a small table of spans (field, ticker, from, to)
beside it. Readers join rows with the later spans and keep, of equal keys, the row of the batch that counts: an aggregate over the
partitions (field, year) that hold several batches, nothing over the others. ``compacted`` folds these again.

In a batch rows stand in order of field, year and ticker, so a slot is a range of tickers. Beside every batch stands its summary: first and last
date and number of rows of each ticker by field, year and slot. Summaries answer for dates and say which slots hold a ticker, without a look at the facts.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT_SCHEMA = "obs_date date, ticker string, value double, source string, created_at date, version long, field string"
FACT_COLUMNS = ("obs_date", "ticker", "value", "source", "created_at", "version", "field")
SUMMARY = "ticker string, first date, last date, n long, field string, year int, slot int"
SPANS = "field string, ticker string, lo date, hi date"
EMPTY = {"facts": [], "batches": {}, "gone": [], "instruments": None, "streams": {}}


class Conflict(Exception):
    """Another writer took the next place in the log."""


class Log:
    """Numbered JSON files in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        p, fs = self._path()
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        found = self.numbers()
        if not found:
            return 0, dict(EMPTY)
        p, fs = self._path(f"{found[-1]:08d}.json")
        stream = fs.open(p)
        try:
            return found[-1], json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def append(self, number: int, state: dict) -> None:
        """Writes a file of its own and moves it to its place, so that readers find it whole; raises Conflict if the place is taken."""
        from py4j.protocol import Py4JJavaError

        draft, fs = self._path(f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, self._path(f"{number:08d}.json")[0], never_over)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            raise Conflict(number) from e

    def trim(self) -> None:
        """Leaves the latest file only."""
        for n in self.numbers()[:-1]:
            p, fs = self._path(f"{n:08d}.json")
            fs.delete(p, False)


class Facts:
    """Batches under a path. A state is what the log holds; an entry of it is [field, year, batch, slots]."""

    def __init__(self, spark: SparkSession, path: str, slot_rows: int):
        self.spark, self.path, self.slot_rows = spark, path, slot_rows

    # writing

    def write(self, rows: DataFrame, total: int) -> tuple[str, list[list]]:
        """A batch of ``total`` rows and its entries. The rows are read twice, for the ranges and for the data."""
        batch, slots = uuid.uuid4().hex, max(1, -(-total // self.slot_rows))
        dated = rows.withColumn("year", F.year("obs_date"))
        ranged = dated.repartitionByRange(slots, "field", "year", "ticker") if slots > 1 else dated.coalesce(1)
        placed = ranged.sortWithinPartitions("field", "year", "ticker", "obs_date").withColumn("slot", F.spark_partition_id())
        placed.write.partitionBy("field", "year", "slot").parquet(f"{self.path}/facts/batch={batch}")
        written = self.spark.read.schema(f"{FACT_SCHEMA}, year int, slot int").parquet(f"{self.path}/facts/batch={batch}")
        spans = written.groupBy("field", "year", "slot", "ticker").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last"), F.count("*").alias("n"))
        spans.write.parquet(f"{self.path}/summaries/batch={batch}")
        held = self.spark.read.schema(SUMMARY).parquet(f"{self.path}/summaries/batch={batch}")
        found: dict[tuple, list[int]] = {}
        for r in held.select("field", "year", "slot").distinct().collect():  # folders
            found.setdefault((r["field"], r["year"]), []).append(r["slot"])
        return batch, [[f, y, batch, sorted(s)] for (f, y), s in sorted(found.items())]

    def write_spans(self, spans: DataFrame) -> str:
        name = uuid.uuid4().hex
        spans.select("field", "ticker", "lo", "hi").write.parquet(f"{self.path}/gone/{name}")
        return name

    # reading

    @staticmethod
    def entries(state: dict, field: str | None = None, lo: int | None = None, hi: int | None = None) -> list[list]:
        return [e for e in state["facts"] if field in (None, e[0]) and (lo is None or e[1] >= lo) and (hi is None or e[1] <= hi)]

    def _read(self, entries: Sequence[list]) -> DataFrame:
        reader = self.spark.read.schema(f"{FACT_SCHEMA}, batch string, year int, slot int").option("basePath", f"{self.path}/facts")
        return reader.parquet(*[f"{self.path}/facts/batch={b}/field={f}/year={y}/slot={s}" for f, y, b, slots in entries for s in slots])

    def _gone(self, state: dict, entries: Sequence[list], cuts_only: bool = False) -> DataFrame | None:
        """Spans (of deletions only, if so) that may cover rows of the entries, with the number of their commit."""
        least = min((state["batches"][e[2]]["number"] for e in entries), default=0)
        out = None
        for name, number, cuts in state["gone"]:
            if number > least and (cuts or not cuts_only):
                spans = self.spark.read.schema(SPANS).parquet(f"{self.path}/gone/{name}").withColumn("at", F.lit(number).cast("long"))
                out = spans if out is None else out.unionAll(spans)
        return out

    def rows(self, state: dict, entries: Sequence[list]) -> DataFrame:
        """The rows that count."""
        if not entries:
            return self.spark.createDataFrame([], FACT_SCHEMA)
        several = {k for k, n in Counter((e[0], e[1]) for e in entries).items() if n > 1}
        gone = self._gone(state, entries)
        batches = [(b, x["number"], x["keep"]) for b, x in state["batches"].items()]
        commits = self.spark.createDataFrame(batches, "batch string, number long, keep boolean")  # a row for each live batch: folding keeps them few

        def left(group: list) -> DataFrame:
            out = self._read(group).join(F.broadcast(commits), "batch")
            if gone is None:
                return out
            covered = (out["field"] == gone["field"]) & (out["ticker"] == gone["ticker"]) & out["obs_date"].between(gone["lo"], gone["hi"]) & (out["number"] < gone["at"])
            return out.join(gone, covered, "left_anti")

        alone = [e for e in entries if (e[0], e[1]) not in several]
        parts = []
        if alone:
            parts.append((left(alone) if gone is not None else self._read(alone)).select(*FACT_COLUMNS))
        if several:
            # a later batch counts before an earlier one; one that keeps what is there counts behind all others, the earliest of these first
            turn = F.when(F.col("keep"), -F.col("number")).otherwise(F.col("number"))
            if any(x["versioned"] for x in state["batches"].values()):
                turn = F.struct(F.coalesce("version", F.lit(-(2**63))), turn)
            best = [F.max_by(c, turn).alias(c) for c in ("value", "source", "created_at", "version")]
            parts.append(left([e for e in entries if (e[0], e[1]) in several]).groupBy("obs_date", "ticker", "field").agg(*best).select(*FACT_COLUMNS))
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    def _summaries(self, entries: Sequence[list]) -> DataFrame:
        """field, ticker, first, last, n, year, slot and batch of the entries."""
        live = self.spark.createDataFrame([(e[2], e[0], e[1]) for e in entries], "batch string, field string, year int")
        reader = self.spark.read.schema(f"{SUMMARY}, batch string").option("basePath", f"{self.path}/summaries")
        read = reader.parquet(*[f"{self.path}/summaries/batch={b}" for b in sorted({e[2] for e in entries})])
        return read.join(F.broadcast(live), ["batch", "field", "year"], "left_semi")

    def dates(self, state: dict, entries: Sequence[list], names: DataFrame | None = None) -> DataFrame:
        """field, ticker, first, last, from the summaries. Facts are read for the tickers and fields only that rows were deleted of and not yet folded.

        Replaced spans don't matter: what replaces them begins and ends where they do.
        """
        if not entries:
            return self.spark.createDataFrame([], "field string, ticker string, first date, last date")
        known = self._summaries(entries)
        known = known if names is None else known.join(names, "ticker", "left_semi")
        ends = (F.min("first").alias("first"), F.max("last").alias("last"))
        cut = self._gone(state, entries, cuts_only=True)
        if cut is None:
            return known.groupBy("field", "ticker").agg(*ends)
        cut = cut.select("field", "ticker").distinct()
        looked_up = cut if names is None else cut.join(names, "ticker", "left_semi")
        facts = self.rows(state, entries).join(looked_up, ["field", "ticker"], "left_semi")
        again = facts.groupBy("field", "ticker").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last"))
        return known.join(cut, ["field", "ticker"], "left_anti").groupBy("field", "ticker").agg(*ends).unionAll(again)

    def year_of(self, state: dict, entries: Sequence[list], names: DataFrame, rows: int) -> int | None:
        """The last year from which on each ticker has at least ``rows`` rows in the entries, or all it has there; None for no rows.

        Of several batches of a partition the greatest counts, and where rows were deleted nothing does: the year may be too early, not too late.
        """
        if not entries:
            return None
        known = self._summaries(entries).join(names, "ticker", "left_semi")
        cut = self._gone(state, entries, cuts_only=True)
        if cut is not None:
            cut = cut.select("field", "ticker").distinct().withColumn("cut", F.lit(True))
            known = known.join(cut, ["field", "ticker"], "left").withColumn("n", F.when(F.col("cut"), 0).otherwise(F.col("n")))
        each = known.groupBy("ticker", "year").agg(F.max("n").alias("n"))
        back = F.sum("n").over(Window.partitionBy("ticker").orderBy(F.desc("year")))
        enough = each.withColumn("back", back).groupBy("ticker").agg(F.max(F.when(F.col("back") >= rows, F.col("year"))).alias("y"), F.min("year").alias("least"))
        return enough.agg(F.min(F.coalesce("y", "least"))).first()[0]

    def holding(self, entries: Sequence[list], names: DataFrame) -> list[list]:
        """The entries with only the slots that hold one of the tickers; where partitions have one slot each, all of it."""
        if all(len(e[3]) == 1 for e in entries):
            return list(entries)
        hits = self._summaries(entries).join(names, "ticker", "left_semi").select("batch", "field", "year", "slot").distinct()
        found: dict[tuple, list[int]] = {}
        for r in hits.collect():  # folders
            found.setdefault((r["field"], r["year"], r["batch"]), []).append(r["slot"])
        return [[*k, sorted(s)] for k, s in found.items()]

    # states

    @staticmethod
    def tidy(state: dict) -> dict:
        """Without batches that no entry names, and spans that no row is older than."""
        held = {e[2] for e in state["facts"]}
        batches = {b: x for b, x in state["batches"].items() if b in held}
        least = min((x["number"] for x in batches.values()), default=None)
        return state | {"batches": batches, "gone": [g for g in state["gone"] if least is not None and g[1] > least]}

    def added(self, state: dict, number: int, batch: str, entries: list[list], keep: bool = False, versioned: bool = False) -> dict:
        return state | {"facts": state["facts"] + entries, "batches": state["batches"] | {batch: {"number": number, "keep": keep, "versioned": versioned}}}

    def compacted(self, state: dict, number: int, chosen: set[tuple]) -> dict:
        """The state with the partitions (field, year) of ``chosen`` folded into one batch."""
        old = [e for e in state["facts"] if (e[0], e[1]) in chosen]
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self.rows(state, old).write.parquet(staged)
        rows = self.spark.read.schema(FACT_SCHEMA).parquet(staged)
        total = rows.count()
        rest = state | {"facts": [e for e in state["facts"] if (e[0], e[1]) not in chosen]}
        versioned = any(state["batches"][e[2]]["versioned"] for e in old)
        if total:
            rest = self.added(rest, number, *self.write(rows, total), versioned=versioned)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return self.tidy(rest)
