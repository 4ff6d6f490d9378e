"""Exact top-k inner products by block-at-a-time pruning.

The vectors' components are integers, floor(scale * x). Documents stand in blocks of consecutive ids; a block's forward index is its
integer matrix, and its term maxima (and minima, for negative query weights) bound what any of its documents can score. Per query
the blocks are ordered by the summed bounds and scored until the next bound falls below the k-th score; a block whose bound
equals it is still scored, as ties go to the smaller id.

Documents stand in the order of their dominant term, so that a block's maxima lie close to its members where the data allow it: bounds skip most
blocks of vectors with few strong terms, and none of vectors spread evenly in all directions (see the README for figures).
Documents are dealt into groups of bounded size, one to a task; every group meets the query blocks as a stream and keeps ``k`` results per
query, and the groups' results are ranked once more.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as padded with
zeros; a query with fewer candidates than k gets all; null ids take no part; rows that repeat an id are candidates each but never
of their own id; pairs whose sums may pass 2**53 are scored in whole numbers of any size, and a pair whose score doesn't fit in 64 bits
is left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import as_matrix, finite, runs, with_columns

SCALE, K, EVERY = 64, 20, 20
#: Documents a block; rows packed into one record; packed records a group holds in memory at most; queries in a record.
BLOCK, PACK, GROUP, QUERIES = 64, 2048, 32, 512


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), parts in runs(batches, ["dim"], rows):
            whole = pa.Table.from_batches(parts)
            x = as_matrix(whole["embedding"].combine_chunks())
            ids = whole["vec_id"].to_numpy().astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([dim], type=pa.int32()), pa.array([ids.tobytes()], type=pa.binary()), pa.array([x.astype("<f8").tobytes()], type=pa.binary())], names=["dim", "ids", "data"])

    return run


PACK_SCHEMA = "dim int, ids binary, data binary"


def scaled(raw: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); infinite where that is beyond doubles."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * raw)


def whole(v: float) -> int:
    """floor(SCALE * v) of any finite number; one too large to be scaled is whole itself."""
    w = SCALE * v
    return math.floor(w) if math.isfinite(w) else int(v) * SCALE


class Forward:
    """Documents of a group: integer matrix, ids, and the bounds of each block."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray]]):
        width = max(x.shape[1] for _, x in packs)
        self.ids = np.concatenate([i for i, _ in packs])
        self.raw = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in packs])
        self.x = scaled(self.raw)
        at = np.arange(0, len(self.ids), BLOCK)
        self.top, self.bottom, self.count = np.maximum.reduceat(self.x, at), np.minimum.reduceat(self.x, at), len(at)
        #: Blocks that were scored, of those that were asked for.
        self.scored = self.asked = 0
        self.greatest = np.abs(self.x).max(axis=1, initial=0)

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, document, score) of the k best of each query; ``q`` is not scaled."""
        return [(int(query), d, s) for query, found in zip(ids, self._best(ids, q, k), strict=True) for d, s in found]

    def _best(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        width = self.x.shape[1]
        raw = np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))[:, :width] if q.shape[1] != width else q
        q = scaled(raw)
        most = max(1.0, float(np.abs(q).max(initial=0))) * width
        large = ~(self.greatest < 2**53 / most)
        if large.any():
            return self._best_large(ids, raw, k, large)
        bound = np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.bottom.T
        order = np.argsort(-bound, axis=1, kind="stable")
        out = []
        for n, query in enumerate(ids):
            best, best_ids, at, step = np.empty(0), np.empty(0, dtype=np.int64), 0, 2
            while at < self.count and (len(best) < k or bound[n, order[n, at]] >= best[-1]):
                take = order[n, at : at + step]
                if len(best) == k:  # bounds fall: those below the k-th score are at the end
                    take = take[bound[n, take] >= best[-1]]
                at, step = at + step, min(2 * step, 64)
                self.scored += len(take)
                rows = (take[:, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
                rows = rows[rows < len(self.ids)]
                score = self.x[rows] @ q[n]
                good = self.ids[rows] != query
                if len(best) == k:
                    good &= score >= best[-1]
                rows, score = rows[good], score[good]
                if len(rows) > 8 * k:  # ties with the k-th stay
                    good = score >= np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[good], score[good]
                score, docs = np.concatenate([best, score]), np.concatenate([best_ids, self.ids[rows]])
                by = np.lexsort((docs, -score))[:k]
                best, best_ids = score[by], docs[by]
            self.asked += self.count
            out.append([(int(d), int(s)) for d, s in zip(best_ids, best, strict=True)])
        return out

    def _best_large(self, ids: np.ndarray, raw: np.ndarray, k: int, large: np.ndarray) -> list[list[tuple[int, int]]]:
        """Documents whose sums may pass 2**53 in Python's integers, the others by blocks; both meet at the end."""
        rest = Forward([(self.ids[~large], self.raw[~large])])._best(ids, raw, k) if not large.all() else [[] for _ in ids]
        docs = [(int(d), [(j, whole(v)) for j, v in enumerate(row) if v]) for d, row in zip(self.ids[large], self.raw[large].tolist(), strict=True)]
        out = []
        for query, row, found in zip(ids.tolist(), raw.tolist(), rest, strict=True):
            weights = [whole(v) for v in row]
            scores = ((d, sum(weights[j] * v for j, v in x)) for d, x in docs if d != query)
            out.append(sorted(found + [(d, s) for d, s in scores if -(2**63) <= s < 2**63], key=lambda x: (-x[1], x[0]))[:k])
        return out


def _serve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packs, forward = None, [], None
        for batch in batches:
            out = []
            for g, kind, dim, ids, data in zip(*(batch.column(c).to_pylist() for c in ("g", "kind", "dim", "ids", "data")), strict=True):
                if g != group:
                    group, packs, forward = g, [], None
                block = np.frombuffer(ids, dtype="<i8"), np.frombuffer(data, dtype="<f8").reshape(-1, dim)
                if kind == 0:
                    packs.append(block)
                elif packs:
                    forward = forward or Forward(packs)
                    out += forward.search(*block, k)
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    common.prepare(spark)
    n = common.parallelism(spark)
    rows = with_columns(vectors).where(finite() & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    size = F.transform("embedding", F.abs)
    lead = F.array_position(size, F.array_max(size))
    ordered = rows.withColumn("lead", F.signum(F.element_at("embedding", lead.cast("int"))) * lead)
    ranged = ordered.repartitionByRange(n, "lead", "vec_id").sortWithinPartitions("dim", "lead", "vec_id").select("dim", "vec_id", "embedding")
    docs = common.materialize(ranged.mapInArrow(_pack(PACK), PACK_SCHEMA).withColumn("no", F.monotonically_increasing_id()), "vector-blocks")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).repartition(n, "vec_id").sortWithinPartitions("dim", "vec_id").select("dim", "vec_id", "embedding")
    queries = asked.mapInArrow(_pack(QUERIES), PACK_SCHEMA)
    blocks = docs.count()
    groups = max(1, -(-blocks // group), min(blocks, 2 * spark.sparkContext.defaultParallelism))
    turn = F.row_number().over(Window.orderBy("no")) - 1  # over one short row for each PACK documents
    number = docs.select("no").withColumn("g", F.floor(turn * groups / blocks).cast("int") if blocks else turn)
    held = docs.join(number, "no").select("g", F.lit(0).alias("kind"), "dim", "ids", "data")
    # the stated query set goes to every group, in blocks
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "dim", "ids", "data")
    dealt = held.unionAll(sent).repartitionById(groups, "g").sortWithinPartitions("g", "kind")
    found = dealt.mapInArrow(_serve(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by brute force in DuckDB's SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
