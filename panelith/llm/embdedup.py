"""Embedding near-duplicates by collision counting over one-dimensional projections.

Equal vectors collapse into one class first. Every class is projected on ``M`` random directions. In a block the projections are
sorted; around each query's value lies a window, a range of ranks, and a pair's count is the number of windows that hold it.
Pairs whose count reaches the calibrated threshold are verified with the exact cosine in double precision, so no reported
link is false. The window is three standard deviations of what a pair at the threshold differs by in one direction, and the count
is the greatest that such a pair reaches with probability ``RECALL``; closer pairs reach it more often.

Blocks are cut along up to ``AXES`` further projections: each axis falls into cells as wide as its own window, so a pair lies in one cell or in
neighbours on every axis. Each cell is the host of its own blocks and of those of the neighbours behind it; a cell of any size is dealt into
blocks of bounded size, and guests pass the host as a stream.
Blocks return link counts per class and a spanning forest of their links, never all pairs.

Edge cases: null, empty and zero vectors and vectors with null or non-finite components link with nothing and stand alone;
vectors of different lengths never link; repeated rows count as linked copies; a null ``vec_id`` takes part and is kept only if its
component has no id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components
from .simhash import NO_ID
from .vectors import as_matrix, finite, runs, with_columns

THRESHOLD, M, DEVIATIONS, CELL_DEVIATIONS, RECALL, BLOCK, SEED, AXES = 0.95, 16, 3.0, 3.0, 0.9995, 2048, 20240101, 3


def needed_collisions(m: int = M, deviations: float = DEVIATIONS, recall: float = RECALL) -> int:
    """The greatest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(deviations / math.sqrt(2))
    tail = 0.0
    for k in range(m, 0, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 1


def directions(dim: int, m: int = M) -> np.ndarray:
    """AXES + m unit directions; the first ones, at right angles as far as the dimension goes, cut the cells."""
    r = np.random.default_rng(SEED).standard_normal((AXES + m, dim))
    for k in range(1, min(AXES, dim)):
        before = r[:k] / np.linalg.norm(r[:k], axis=1, keepdims=True)
        r[k] -= before.T @ (before @ r[k])
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _chord(threshold: float) -> float:
    return math.sqrt(2 - 2 * threshold)


def _window(dim: int, threshold: float, deviations: float) -> float:
    """No two unit vectors within the chord differ by more than the chord in any direction."""
    return _chord(threshold) * min(1.0, deviations / math.sqrt(dim)) + 1e-12


def cells(rows: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The cell of each unit vector on each axis; axes beyond the dimension are not cut."""
    dim = rows.shape[1]
    out = np.floor(rows @ directions(dim)[:AXES].T / _window(dim, threshold, CELL_DEVIATIONS)).astype(np.int32)
    out[:, dim:] = 0
    return out


def _cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            dims = np.array(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype=np.int32)
            found = np.zeros((len(dims), AXES), dtype=np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                found[at] = cells(unit(as_matrix(column.take(pa.array(at)))), threshold)
            cell = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), AXES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), cell], names=[*batch.schema.names, "dim", "cell"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (dim, cell, tile), parts in runs(batches, ["dim", "cell", "tile"], 1 << 62):
        whole = pa.Table.from_batches(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], type=t) for x, t in ((dim, pa.int32()), (cell, pa.list_(pa.int32())), (tile, pa.int32()))]
            + [pa.array([whole[c].to_numpy().astype("<i8").tobytes()], type=pa.binary()) for c in ("class_id", "copies")]
            + [pa.array([as_matrix(whole["embedding"].combine_chunks()).tobytes()], type=pa.binary())],
            names=["dim", "cell", "tile", "ids", "copies", "data"],
        )


PACK_SCHEMA = "dim int, cell array<int>, tile int, ids binary, copies binary, data binary"


def colliding(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, m: int = M) -> np.ndarray:
    """Which pairs of unit vectors reach the needed count: sorted projections, windows as ranges of ranks."""
    dim, need = a.shape[1], needed_collisions(m)
    r, half = directions(dim, m)[AXES:], _window(dim, threshold, DEVIATIONS)
    pa_, pb = a @ r.T, b @ r.T
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for t in range(m):
        order = np.argsort(pb[:, t], kind="stable")
        rank = np.empty(len(b), dtype=np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        line = pb[order, t]
        lo = np.searchsorted(line, pa_[:, t] - half, side="left").astype(np.uint16)
        width = np.searchsorted(line, pa_[:, t] + half, side="right").astype(np.uint16) - lo
        for k in range(0, len(a), 256):
            count[k : k + 256] += (rank[None, :] - lo[k : k + 256, None]) < width[k : k + 256, None]
    return count >= need


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs as two index arrays."""
    hit = colliding(a, b, threshold)
    i, j = np.nonzero(hit)
    if len(i) > hit.size // 16:  # dense: all cosines at once are cheaper
        i, j = np.nonzero(hit & (a @ b.T >= threshold - 1e-9))
    keep = np.empty(len(i), dtype=bool)
    for k in range(0, len(i), 100_000):
        keep[k : k + 100_000] = np.einsum("ij,ij->i", a[i[k : k + 100_000]], b[j[k : k + 100_000]]) >= threshold
    return i[keep], j[keep]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the edges (i, j) on n nodes, without the roots."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _linked(host: tuple, guest: tuple | None, threshold: float) -> pa.RecordBatch | None:
    """Link counts and a forest of the links inside the host, or between host and guests."""
    ids, copies, a = host
    if guest is None:
        i, j = _links(a, a, threshold)
        i, j = i[i < j], j[i < j]
        every, weight_j, off = ids, copies, 0
    else:
        i, j = _links(a, guest[2], threshold)
        every, weight_j, off = np.concatenate([ids, guest[0]]), guest[1], len(ids)
    if not len(i):
        return None
    n = np.bincount(i, weights=weight_j[j], minlength=len(every)) + np.bincount(j + off, weights=copies[i], minlength=len(every))
    has = np.flatnonzero(n)
    node, root = spanning(i, j + off, len(every))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([every[has], every[node]])),
            pa.array(np.concatenate([np.full(len(has), -1), every[root]]).astype(np.int64)),
            pa.array(np.concatenate([n[has], np.zeros(len(node))]).astype(np.int64)),
        ],
        names=["a", "b", "n"],
    )


def _hosts(threshold: float, most: int):
    """Rows sorted by (dim, at, host, guest): a host block, then its guests, which are compared some ``most`` vectors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, host, wait, size = None, None, [], 0

        def meet():
            guests = tuple(np.concatenate([g[k] for g in wait]) for k in range(3))
            return _linked(host, guests, threshold)

        for batch in batches:
            for dim, at, tile, guest, *raw in zip(*(batch.column(c).to_pylist() for c in ("dim", "at", "host", "guest", "ids", "copies", "data")), strict=True):
                block = np.frombuffer(raw[0], dtype="<i8"), np.frombuffer(raw[1], dtype="<i8"), unit(np.frombuffer(raw[2], dtype="<f8").reshape(-1, dim))
                out = []
                if (dim, at, tile) != key:
                    if wait:
                        out.append(meet())
                    key, host, wait, size = (dim, at, tile), block, [], 0
                    if guest:
                        raise ValueError("a block came without its host")
                    out.append(_linked(host, None, threshold))
                else:
                    wait.append(block)
                    size += len(block[0])
                    if size >= most:
                        out.append(meet())
                        wait, size = [], 0
                yield from (x for x in out if x is not None)
        if wait and (last := meet()) is not None:
            yield last

    return run


def _meetings(packs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every block as host (guest 0) and as guest (1) of the blocks of its cell before it and of all blocks of the neighbours before its cell."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=AXES) if s > (0,) * AXES]
    to = F.array(*[F.array(*[F.col("cell")[k] - s[k] for k in range(AXES)]) for s in steps])
    own = packs.select("dim", F.col("cell").alias("at"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("host"), "tile", "ids", "copies", "data")
    own = own.select("dim", "at", "host", (F.col("host") != F.col("tile")).cast("int").alias("guest"), "ids", "copies", "data")
    away = packs.select("dim", F.explode(to).alias("at"), "ids", "copies", "data").join(sizes.select("dim", F.col("cell").alias("at"), "tiles"), ["dim", "at"])
    away = away.select("dim", "at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("host"), F.lit(1).alias("guest"), "ids", "copies", "data")
    return own.unionAll(away)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    common.prepare(spark)
    n = common.parallelism(spark)
    rows = with_columns(vectors)
    usable = finite() & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(usable, F.col("embedding"))).withColumn("key", F.xxhash64("embedding"))
    grouped = rows.where("embedding is not null").groupBy("key", "embedding").agg(F.count("*").alias("copies"), F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("least"))
    classes = common.materialize(grouped.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    given = classes.select("embedding", "copies", "class_id")
    placed = common.materialize(given.mapInArrow(_cells(threshold), "embedding array<double>, copies long, class_id long, dim int, cell array<int>"), "vector-cells")
    # cells of one length: at most (2 / width + 2) ** AXES, whatever the number of vectors
    sizes = common.materialize(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("tiles")), "vector-sizes")
    tiled = placed.join(sizes, ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
    packed = tiled.repartition(n, "dim", "cell", "tile").sortWithinPartitions("dim", "cell", "tile").select("dim", "cell", "tile", "class_id", "copies", "embedding").mapInArrow(_pack, PACK_SCHEMA)
    packs = common.materialize(packed, "vector-blocks")
    # a tile that no vector fell into has no host: its guests have nothing to meet
    hosts = packs.select("dim", F.col("cell").alias("at"), F.col("tile").alias("host"))
    meet = _meetings(packs, sizes).join(hosts, ["dim", "at", "host"], "left_semi")
    dealt = meet.repartition(max(n, 4 * spark.sparkContext.defaultParallelism), "dim", "at", "host").sortWithinPartitions("dim", "at", "host", "guest")
    found = common.materialize(dealt.mapInArrow(_hosts(threshold, block), "a long, b long, n long"), "vector-links")
    common.discard(packs, placed, sizes)
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n"))
    roots = common.materialize(connected_components(found.where("b >= 0")), "vector-roots")
    linked = classes.select("class_id", "least").join(roots, F.col("class_id") == F.col("v"))
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(best, "root").select("class_id", "component")
    facts = classes.join(counts, F.col("class_id") == F.col("a"), "left").join(named, "class_id", "left")
    facts = facts.select("key", "embedding", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component"))
    facts = common.materialize(facts, "vector-facts")
    held = common.look_up(rows.where("embedding is not null"), facts, ["key", "embedding"], "copies", rows.count())
    held = held.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.nullif("component", F.lit(NO_ID)).alias("component_id"))
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return held.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same by brute force in DuckDB's SQL.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a
), m AS (
  SELECT a, min(c) AS component_id FROM r GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON v.vec_id = m.a
"""
