"""Panels that are scanned when it is known what is needed of them.

A part of a strategy (universe filter, signal, weight, overlay, index) says how many rows it looks back from its first date. A ``StoredPanel`` turns this
into a date before any plan is built, from the store's summaries: the last year from whose begin on every ticker has so many rows before the first date,
or all it ever had. The scan then opens the partitions from that year to the last date only, and no metric differs from that of the whole panel.

A metric over each n-th row counts its rows back from the panel's latest date and so needs everything; one over a weekday's rows is given ``WEEKLY`` rows
for each of its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[dt.date, dt.date | None]

#: Rows that are looked back for a row of one weekday: a week's, and as many again for weeks without one.
WEEKLY = 10


class StoredPanel:
    """A data type of a store for some tickers, as ``PanelStore.get`` returns it."""

    def __init__(self, store, tickers, data_type: str = "close", **how):
        self.store, self.tickers, self.data_type, self.how = store, tickers, data_type, how

    def since(self, first: dt.date, rows: int | None, freq: int | str | None = None) -> dt.date | None:
        """The date from which on metrics over ``rows`` rows are whole on ``first``; None if all is needed."""
        if rows is None or (isinstance(freq, int) and freq > 1):
            return None
        field = "volume" if self.data_type == "volume" else "close"
        return self.store.since(field, self.tickers, first, rows * WEEKLY if isinstance(freq, str) else rows)

    def over(self, span: Span, rows: int | None, freq: int | str | None = None) -> DataFrame:
        end = None if isinstance(freq, int) and freq > 1 else span[1]
        return self.store.get(self.data_type, self.tickers, start=self.since(span[0], rows, freq), end=end, **self.how)


Panel = DataFrame | StoredPanel


def cut(panel: Panel, span: Callable[[], Span], rows: int | None, freq: int | str | None = None) -> DataFrame:
    """What is needed of a panel; a DataFrame is taken as it is, and the span is asked for a stored one only."""
    return panel if isinstance(panel, DataFrame) else panel.over(span(), rows, freq)


def span_of(panel: DataFrame) -> Span:
    r = panel.agg(F.min("obs_date"), F.max("obs_date")).first()
    if r[0] is None:
        raise ValueError("there are no dates")
    return r[0], r[1]
