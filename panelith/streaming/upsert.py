"""Micro-batches of facts into the panel store.

The engine's refresh is an incremental batch; this lets a file stream feed the same upsert, one commit per batch.
A micro-batch holds whatever came last, so by default it replaces rows of the very date, ticker and field only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import PanelStore


def upsert_stream(facts: DataFrame, store: PanelStore, checkpoint: str, replace: bool | str = "exact", order: str | None = None) -> StreamingQuery:
    """Feeds a streaming DataFrame (obs_date, ticker, field, value) into the store until its input ends.

    A batch may hold several versions of a fact. ``order`` names a column of whole numbers, such as the event's time or an offset: the version with
    the greatest counts, also against batches before and behind, so that late versions change nothing. Without it the greatest value of a
    batch counts, and a later batch before an earlier one. A batch that is given again after a failure is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if order is None:
            key = [F.col("obs_date"), F.upper("ticker").alias("ticker"), F.col("field")]
            batch = batch.groupBy(*key).agg(F.max("value").alias("value"))
        store.upsert(batch, replace=replace, order=order, token=(checkpoint, batch_id))

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
