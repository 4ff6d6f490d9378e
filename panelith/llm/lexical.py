"""Ranked lexical search through hierarchical max trees over ranges of documents.

A term's contribution to a document's score depends on that document alone, so for every term the greatest contribution within a range
of documents bounds what any of them can gain by it. Documents are dealt, where they are read, into shards of consecutive rows; in a
shard, leaves of ``LEAF`` documents and above them nodes of ``FAN`` children each hold the maxima of every term: a tree per term, all over
the same ranges. A query's bound of a node is the sum of its terms' maxima. Best-first branch-and-bound opens the node of the highest
bound, scores the documents of a leaf from their postings, and ends when the highest bound left lies below the k-th score; nodes
whose bound equals it are still opened, as ties go to the smaller id.

The trees' roots are met in Spark: summed bounds by item and shard say which shard each item looks into first. The k-th score found there
is the item's threshold, and only shards whose bound reaches it are searched after that, with the threshold given. Shards meet the
items that ask for them in blocks of about ``ITEMS``; each task holds one shard, which has at most ``SHARD`` documents and,
but for the last document's, ``POSTINGS`` postings. Only asked terms are indexed: a bitmap of ``BITS`` hashed terms is the one thing sent to all
tasks; other terms that share a bit are indexed too and found by nobody.

Edge cases: null and empty texts have no terms, count for nothing and are never found; null ids come last among equal scores; rows that
repeat are documents each; repeated rows of an item are one item, and different texts of one item id are ranked each; items without
terms give no rows; an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
#: Documents of a leaf, children of a node, and what a shard holds; items that a task meets with one shard, about.
LEAF, FAN = 64, 8
SHARD, POSTINGS, ITEMS = 8192, 1 << 20, 512
#: Bits of the map of asked terms, and bytes of a text that are cut into words at once.
BITS, CHUNK = 1 << 20, 1 << 20

# A-Z become a-z; all other ASCII signs but digits and letters part words; bytes of other characters belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def count_terms(data: bytes) -> tuple[Counter, int]:
    """How often each term occurs in a text in UTF-8, and how many terms it has in all."""
    folded = data.translate(FOLD)
    counts: Counter = Counter()
    n = at = 0
    while at < len(folded):
        to = len(folded)
        if at + CHUNK < to:  # whole words
            to = folded.rfind(b" ", at, at + CHUNK)
            to = to if to > at else folded.find(b" ", at + CHUNK)
            to = to if to > at else len(folded)
        words = folded[at:to].split()
        counts.update(words)
        n, at = n + len(words), to
    return counts, n


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 75 + (25 * lengths * n) // total


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, t, c) for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t, c in count_terms((text.as_py() or "").encode())[0].items()]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.binary()), pa.array(cols[1], type=pa.binary()), pa.array(cols[2], type=pa.int64())], names=["item", "term", "times"])


SHARD_SCHEMA = "shard long, n_docs long, n_terms long, ids binary, absent binary, lengths binary, terms array<binary>, dfs array<long>, docs binary, tfs binary"
_SHARD_TYPES = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
_SHARD_NAMES = [f.split(" ")[0] for f in SHARD_SCHEMA.split(", ")]


class _Open:
    """A shard while documents are added."""

    def __init__(self):
        self.n_docs = self.n_terms = 0
        self.ids, self.absent, self.lengths = array("q"), bytearray(), array("q")
        self.known: dict[bytes, int] = {}
        self.terms, self.docs, self.tfs = array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, data: bytes, asked: bytes) -> None:
        counts, n = count_terms(data)
        self.n_docs += n > 0
        self.n_terms += n
        held = [(t, c) for t, c in counts.items() if asked[(h := zlib.crc32(t) & (BITS - 1)) >> 3] >> (h & 7) & 1]
        if not held:
            return
        known, at = self.known, len(self.ids)
        for t, c in held:
            self.terms.append(known.setdefault(t, len(known)))
            self.tfs.append(c)
        self.docs.extend([at] * len(held))
        self.ids.append(0 if doc_id is None else doc_id)
        self.absent.append(doc_id is None)
        self.lengths.append(n)

    def full(self) -> bool:
        return len(self.ids) >= SHARD or len(self.docs) >= POSTINGS

    def row(self, shard: int) -> tuple:
        terms = np.frombuffer(self.terms, dtype="<i8") if self.terms else np.empty(0, dtype="<i8")
        order = np.argsort(terms, kind="stable")
        docs, tfs = (np.array(x, dtype="<i8")[order] for x in (self.docs, self.tfs))
        dfs = np.bincount(terms, minlength=len(self.known))
        return (shard, self.n_docs, self.n_terms, self.ids.tobytes(), bytes(self.absent), self.lengths.tobytes(), list(self.known), dfs.tolist(), docs.astype("<u2").tobytes(), tfs.astype("<u4").tobytes())


def _index(asked: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, _Open()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(shard.row(number), _SHARD_TYPES, strict=True)], names=_SHARD_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"", asked)
                if shard.full():
                    yield out()
                    number, shard = number + 1, _Open()
        if shard.n_docs:
            yield out()

    return run


class MaxTree:
    """A shard's postings and, for the terms that queries ask for, the maxima of every range."""

    #: Terms whose maxima are kept at hand.
    HELD = 8192

    def __init__(self, record: dict, n: int, total: int):
        self.ids = np.frombuffer(record["ids"], dtype="<i8")
        self.absent = np.frombuffer(record["absent"], dtype="u1").astype(bool)
        self.docs = np.frombuffer(record["docs"], dtype="<u2").astype(np.int64)
        m = norms(np.frombuffer(record["lengths"], dtype="<i8"), n, total)
        self.gain = contribution(np.frombuffer(record["tfs"], dtype="<u4").astype(np.int64), m[self.docs])
        self.starts = np.concatenate([[0], np.cumsum(np.array(record["dfs"], dtype=np.int64))])
        self.at = {t: k for k, t in enumerate(record["terms"])}
        self.leaves = -(-len(self.ids) // LEAF)
        self._levels: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        #: Leaves that were scored, of those that were asked for.
        self.scored = self.asked = 0

    def roots(self) -> np.ndarray:
        """The greatest contribution of each term."""
        return np.maximum.reduceat(self.gain, self.starts[:-1]) if len(self.gain) else self.gain

    def _term(self, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Maxima of a term's nodes from the root down to the leaves, and where each leaf's postings begin."""
        got = self._levels.get(k)
        if got is None:
            if len(self._levels) >= self.HELD:
                self._levels.clear()
            a, b = self.starts[k], self.starts[k + 1]
            begins = np.searchsorted(self.docs[a:b], np.arange(self.leaves + 1) * LEAF) + a
            level = np.zeros(self.leaves, dtype=np.int64)
            full = np.flatnonzero(begins[1:] > begins[:-1])
            level[full] = np.maximum.reduceat(self.gain[:b], begins[full])
            levels = [level]
            while len(levels[-1]) > 1:
                below = levels[-1]
                levels.append(np.pad(below, (0, -len(below) % FAN)).reshape(-1, FAN).max(axis=1))
            got = self._levels[k] = (levels[::-1], begins)
        return got

    def search(self, terms: list[bytes], weights: list[int], k: int, least: int) -> list[tuple[int | None, int]]:
        """(doc_id, score) of the ``k`` best with a score of at least ``least``, best first."""
        here = [(self.at[t], w) for t, w in zip(terms, weights, strict=True) if t in self.at]
        if not here:
            return []
        weight = np.array([w for _, w in here], dtype=np.int64)
        trees = [self._term(t) for t, _ in here]
        levels = [np.stack([t[0][depth] for t in trees]) for depth in range(len(trees[0][0]))]
        begins = np.stack([t[1] for t in trees])
        bottom = len(levels) - 1
        self.asked += self.leaves
        heap = [(-int(weight @ levels[0][:, 0]), 0, 0)]
        score, docs, floor = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), max(1, least)
        while heap and -heap[0][0] >= floor:
            _, depth, node = heapq.heappop(heap)
            if depth < bottom:
                below = levels[depth + 1][:, node * FAN : (node + 1) * FAN]
                for child, bound in enumerate((weight @ below).tolist()):
                    if bound >= floor:
                        heapq.heappush(heap, (-bound, depth + 1, node * FAN + child))
                continue
            self.scored += 1
            got = np.zeros(LEAF, dtype=np.int64)
            for t in np.flatnonzero(begins[:, node + 1] > begins[:, node]):
                a, b = begins[t, node], begins[t, node + 1]
                got[self.docs[a:b] - node * LEAF] += weight[t] * self.gain[a:b]  # a term has a document once
            good = np.flatnonzero(got >= floor)
            if len(good):
                score, docs = np.concatenate([score, got[good]]), np.concatenate([docs, good + node * LEAF])
                best = np.lexsort((self.ids[docs], self.absent[docs], -score))[:k]
                score, docs = score[best], docs[best]
                floor = max(floor, int(score[-1])) if len(score) == k else floor
        return [(None if self.absent[d] else int(self.ids[d]), int(s)) for d, s in zip(docs, score, strict=True)]


_HELD = ["ids", "absent", "lengths", "terms", "dfs", "docs", "tfs"]


def _roots(n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best = MaxTree(row, n, total).roots()
                yield pa.RecordBatch.from_arrays([pa.array(row["terms"], type=pa.binary()), pa.array([row["shard"]] * len(best), type=pa.int64()), pa.array(best, type=pa.int64())], names=["term", "shard", "best"])

    return run


def _serve(n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = tree = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard = tree = None
                if row["item"] is None:
                    if tree is None:
                        shard, tree = row["shard"], MaxTree(row, n, total)
                else:
                    out += [(row["item"], d, s) for d, s in tree.search([a["term"] for a in row["wanted"]], [a["weight"] for a in row["wanted"]], k, row["least"])]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.binary()), pa.array(cols[1], type=pa.int64()), pa.array(cols[2], type=pa.int64())], names=["item", "doc_id", "score"])

    return run


def _bitmap(terms: DataFrame) -> bytes:
    """``BITS`` bits, those of the terms' hashes set."""
    bit = F.crc32("term") % BITS
    words = terms.select(F.floor(bit / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(crc32(term) % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(BITS // 32, dtype="<u4")
    for r in words.collect():  # at most BITS / 32 rows
        out[r["word"]] = r["bits"]
    return out.tobytes()


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) with the highest scores above 0 of each item (item_id, text)."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = common.parallelism(spark)
    named = common.pick(items, ["item_id", "text"]).where("text is not null").distinct()
    named = common.materialize(named.withColumn("item", F.unhex(F.sha2(F.concat_ws(":", F.col("item_id").cast("string"), F.col("item_id").isNull().cast("string"), "text"), 256))), "items")
    asked = common.materialize(named.select("item", "text").mapInArrow(_item_terms, "item binary, term binary, times long"), "asked")
    rows = common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = common.materialize(rows.mapInArrow(_index(_bitmap(asked)), SHARD_SCHEMA), "shards")
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n:
        return spark.createDataFrame([], items.select("item_id").schema).selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score")

    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = common.materialize(asked.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"), "weights")
    wanted = weights.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("wanted"))

    roots = shards.select("shard", *_HELD).mapInArrow(_roots(n, total), "term binary, shard long, best long")
    bounds = common.materialize(roots.join(weights, "term").groupBy("item", "shard").agg(F.sum(F.col("best") * F.col("weight")).alias("bound")), "bounds")
    blocks = max(1, -(-named.count() // ITEMS))

    def serve(todo: DataFrame) -> DataFrame:
        """Results of (item, shard, least)."""
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        none = [F.lit(None).cast("binary").alias("item"), F.lit(None).cast(wanted.schema["wanted"].dataType).alias("wanted"), F.lit(None).cast("long").alias("least")]
        held = shards.join(dealt.select("shard", "block").distinct(), "shard").select("shard", "block", *_HELD, *none)
        nothing = [F.lit(None).cast(shards.schema[c].dataType).alias(c) for c in _HELD]
        sent = dealt.join(wanted, "item").select("shard", "block", *nothing, "item", "wanted", "least")
        met = held.unionAll(sent).repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "item")
        return met.mapInArrow(_serve(n, total, k), "item binary, doc_id long, score long")

    first = bounds.groupBy("item").agg(F.max(F.struct("bound", -F.col("shard"))).alias("b")).select("item", (-F.col("b.col2")).alias("shard"), F.lit(1).cast("long").alias("least"))
    found = common.materialize(serve(first), "found")
    reached = found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    passed = first.select("item", F.col("shard").alias("done")).join(reached, "item", "left")
    left = bounds.join(passed, "item").select("item", "shard", "bound", "done", F.when(F.col("n") >= k, F.col("kth")).otherwise(1).alias("least"))
    more = serve(left.where("shard <> done and bound >= least").select("item", "shard", "least"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.unionAll(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same by brute force in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0
), p AS (
  SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d
), tf AS (
  SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf, 75 + (25 * any_value(n) * any_value(n_all)) // any_value(l_all) AS m FROM p, s GROUP BY row, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) GROUP BY item_id, row, doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
