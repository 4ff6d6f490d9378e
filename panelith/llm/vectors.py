"""Packing of vectors into blocks, shared by the embedding operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(col: str = "embedding"):
    """True for vectors without null or non-finite components; null and empty vectors give false."""
    c = F.col(col)
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.coalesce(ok, F.lit(False)), F.lit(False))


def as_matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups sorted batches by ``keys`` and cuts groups at ``most`` rows."""
    head, waiting, size = None, [], 0
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
        at = 0
        while at < len(values):
            if head is not None and (values[at] != head or size >= most):
                yield head, waiting
                waiting, size = [], 0
            head = values[at]
            to = at
            while to < len(values) and values[to] == head and size + to - at < most:
                to += 1
            waiting.append(batch.slice(at, to - at))
            size += to - at
            at = to
    if waiting:
        yield head, waiting


def with_columns(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
