"""Moments of every two tickers by blocked Gram matrices.

Dates are dealt into blocks and tickers into tiles; a tile of a block is one dense array, dates by tickers. Two tiles of a block meet once and give the
products of all their pairs at one go, so what is shuffled are arrays and tile pairs, not pairs of tickers on each date. Partial sums of the
blocks are added up by tile pair: counts, sums, squares and products over the dates that both tickers have.

Values are taken relative to a value of their ticker, its first one, so that large levels lose no digits; covariances do not change by that.
Each pair of tickers is computed once and returned in both orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dates of a block and tickers of a tile: a tile of a block has 8 bytes for each cell, a pair of tiles six sums for each pair of tickers.
DATES, TICKERS = 512, 128
#: Pairs of tiles whose sums a task holds (under 1 MB each).
HELD = 64
SUMS = ("n", "rows", "sx", "sy", "sxx", "syy", "sxy")


def products(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> list[np.ndarray]:
    """The sums (dates by tickers; NaN: missing) of every column of ``x`` with every one of ``y``; ``rx`` and ``ry`` mark cells that are rows."""
    hx, hy = ~np.isnan(x), ~np.isnan(y)
    x, y, hx, hy = np.where(hx, x, 0.0), np.where(hy, y, 0.0), hx.astype(float), hy.astype(float)
    return [hx.T @ hy, rx.astype(float).T @ ry.astype(float), x.T @ hy, hx.T @ y, (x * x).T @ hy, hx.T @ (y * y), x.T @ y]


def _cells(record: dict) -> tuple[np.ndarray, np.ndarray]:
    """Dense values and marks of rows, as large as the cells need."""
    at = np.array(record["d"]), np.array(record["t"])
    shape = at[0].max() + 1, at[1].max() + 1
    x, rows = np.full(shape, np.nan), np.zeros(shape, dtype=bool)
    x[at] = np.array([np.nan if v is None else v for v in record["v"]], dtype=float)
    rows[at] = True
    return x, rows


def _taller(x: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    more = ((0, n - len(x)), (0, 0))
    return np.pad(x, more, constant_values=np.nan), np.pad(rows, more)


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The sum of two stacks of sums, as large as both need."""
    if a is None:
        return b
    out = np.zeros((len(SUMS), max(a.shape[1], b.shape[1]), max(a.shape[2], b.shape[2])))
    out[:, : a.shape[1], : a.shape[2]] += a
    out[:, : b.shape[1], : b.shape[2]] += b
    return out


_SUMS_SCHEMA = "i int, j int, width int, sums array<double>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles become sums; those of the same pair of tiles that a task meets are added up first."""
    held: dict[tuple, np.ndarray] = {}
    key_type = pa.null()

    def out() -> pa.RecordBatch:
        keys, stacks = list(held), list(held.values())
        flat = pa.array(np.concatenate([s.ravel() for s in stacks]) if stacks else np.empty(0))
        offsets = pa.array(np.cumsum([0, *(s.size for s in stacks)]).astype(np.int32))
        cols = [pa.array([dict(k[0]) for k in keys], type=key_type), pa.array([k[1] for k in keys], type=pa.int32()), pa.array([k[2] for k in keys], type=pa.int32()), pa.array([s.shape[2] for s in stacks], type=pa.int32())]
        held.clear()
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, flat)], names=["key", "i", "j", "width", "sums"])

    for batch in batches:
        key_type = batch.schema.field("key").type
        for r in batch.to_pylist():
            (x, rx), (y, ry) = _cells(r["a"]), _cells(r["b"])
            n = max(len(x), len(y))
            pair = tuple(r["key"].items()), r["i"], r["j"]
            held[pair] = _added(held.get(pair), np.stack(products(*(v for two in zip(_taller(x, rx, n), _taller(y, ry, n), strict=True) for v in two))))
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def _pairs(tickers: int):
    """Sums, by key and pair of tiles and in order, become a row for each pair of tickers that has rows together, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out(key_type: pa.DataType) -> pa.RecordBatch:
            key, i, j = now
            p, q = np.nonzero(total[1] > 0)
            once = (i < j) | (p <= q)
            p, q = p[once], q[once]
            cols = [pa.array([dict(key)] * len(p), type=key_type), pa.array((p + i * tickers).astype(np.int32)), pa.array((q + j * tickers).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(total[k][p, q]) for k in range(len(SUMS)))], names=["key", "p", "q", *SUMS])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for key, i, j, width, sums in zip(*(batch.column(k).to_pylist() if k < 4 else batch.column(k) for k in range(5)), strict=True):
                pair = tuple(key.items()), i, j
                if now is not None and pair != now:
                    yield out(key_type)
                    total = None
                now = pair
                total = _added(total, sums.values.to_numpy().reshape(len(SUMS), -1, width))
        if now is not None:
            yield out(key_type)

    return run


def moments(panel: DataFrame, keys: Sequence[str], dates: int = DATES, tickers: int = TICKERS) -> DataFrame:
    """keys, ticker_1, ticker_2 and, over the dates that both have a value (n) or a row (rows), the sums of values, squares and products.

    ``panel`` has one row a date and ticker within the keys; missing values are NULL.
    """
    keys = list(keys)
    named = panel.select(F.struct(*keys, F.lit(0).alias("_")).alias("key"), "obs_date", "ticker", "value")
    # numbers of tickers: a table of one row per ticker
    order = Window.orderBy("ticker")
    names = named.groupBy("ticker").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("obs_date"))).alias("base")).withColumn("no", F.row_number().over(order) - 1)
    placed = named.join(names, "ticker").select(
        "key",
        F.floor(F.datediff("obs_date", F.lit("1970-01-01")) / dates).cast("int").alias("block"),
        F.pmod(F.datediff("obs_date", F.lit("1970-01-01")), F.lit(dates)).cast("int").alias("d"),
        F.floor(F.col("no") / tickers).cast("int").alias("tile"),
        F.pmod("no", F.lit(tickers)).cast("int").alias("t"),
        (F.col("value") - F.col("base")).alias("v"),
    )
    tiles = placed.groupBy("key", "block", "tile").agg(F.collect_list(F.struct("d", "t", "v")).alias("cells"))  # at most dates x tickers cells
    x = F.struct(*[F.col(f"cells.{n}").alias(n) for n in ("d", "t", "v")])
    a = tiles.select("key", "block", F.col("tile").alias("i"), x.alias("a"))
    b = tiles.select("key", "block", F.col("tile").alias("j"), x.alias("b"))
    met = a.join(b, ["key", "block"]).where("i <= j").select("key", "i", "j", "a", "b")
    kind = met.schema["key"].dataType.simpleString()
    partial = met.mapInArrow(_meet, f"key {kind}, {_SUMS_SCHEMA}")
    dealt = partial.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    both = dealt.mapInArrow(_pairs(tickers), f"key {kind}, p int, q int, {', '.join(f'{c} double' for c in SUMS)}")
    swapped = both.where("p < q").select("key", F.col("q").alias("p"), F.col("p").alias("q"), "n", "rows", F.col("sy").alias("sx"), F.col("sx").alias("sy"), F.col("syy").alias("sxx"), F.col("sxx").alias("syy"), "sxy")
    one, two = (names.select(F.col("no").alias(k), F.col("ticker").alias(f"ticker_{n}")) for n, k in ((1, "p"), (2, "q")))
    return both.unionByName(swapped).join(one, "p").join(two, "q").select(*[F.col("key")[k].alias(k) for k in keys], "ticker_1", "ticker_2", *SUMS)


def covariance() -> Column:
    """Sample covariance from the sums; NULL for a single date."""
    return F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1)


def correlation() -> Column:
    """Pearson's correlation from the sums; NULL where a ticker does not vary."""
    x, y = (F.col(f"s{k}{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n") for k in "xy")
    return F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(x * y))
