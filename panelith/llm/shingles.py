"""SimHash near-duplicates at a Jaccard similarity of word shingles.

A text is the set of its shingles of ``WIDTH`` words in lower case; a shorter text is one shingle. Equal sets collapse first. A set has a
64-bit SimHash, and sets are compared in blocks: those that agree in all rows of one of 16 sketches of least hashes share one, a pair of
similarity 0.8 with probability 0.9998, a closer pair more often. Inside a block the fingerprints are compared as bit planes (``simhash.Planes``)
within the radius that a pair at the similarity keeps by five standard deviations; the groups that are left are verified on whole sets (as 32-bit hashes) and
return a spanning forest of their links; blocks with the same members count once. A block too large for a task is cut into tiles that meet
pair by pair, so no pair is lost and no task holds an unbounded group; the rows of such a block grow with its number of tiles.

Edge cases: texts without words are one group; a null ``doc_id`` counts as the greatest; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Sets and shingles of a tile.
TILE, TILE_SHINGLES = 2048, 2_000_000
_RANDOM = np.random.default_rng(simhash.SEED)
_TIMES = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
PRINT_SCHEMA = "doc_id long, mark long, row long, fp long, sim long, n int, bands array<long>, grams binary"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode().translate(simhash._LOWER).split()
    n = max(1, len(words) - width + 1) if words else 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, simhash.SEED) for w in words), dtype=np.uint64, count=len(words))
    code = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        code = (code ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return np.unique(code)


def fingerprint(grams: np.ndarray) -> int:
    """Stands for the whole set; signed, and 0 if it is empty."""
    return simhash._signed(xxhash.xxh64_intdigest(grams.tobytes(), simhash.SEED)) if len(grams) else 0


def radius(similarity: float) -> int:
    """Bits that two sets at the similarity differ in at most, but for five standard deviations; sets of equal size differ most."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(simhash.BITS * p + 5 * math.sqrt(simhash.BITS * p * (1 - p)))


def simhash_of(grams: np.ndarray) -> int:
    """The SimHash of a set; signed."""
    total = np.zeros(simhash.BITS, dtype=np.int64)
    for k in range(0, len(grams), 32_768):
        total += np.unpackbits(grams[k : k + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view("<i8")[0])


def bands(grams: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(grams), 512):
        least = np.minimum(least, (grams[k : k + 512, None] * _TIMES + _PLUS).min(axis=0))
    return [simhash._signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)] if len(grams) else []


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sims, n, keys, sets = [], [], [], [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py(), width)
                fps.append(fingerprint(grams))
                sims.append(simhash_of(grams))
                keys.append(bands(grams))
                sets.append(np.unique(grams.astype("<u4")).tobytes())
                n.append(len(sets[-1]) // 4)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fps, type=pa.int64()), pa.array(sims, type=pa.int64()), pa.array(n, type=pa.int32()), pa.array(keys, type=pa.list_(pa.int64())), pa.array(sets, type=pa.binary())],
                names=["doc_id", "mark", "row", "fp", "sim", "n", "bands", "grams"],
            )

    return run


def forest(fps: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that connect each group of sets linked by the similarity."""
    size = np.array([len(s) for s in sets])
    if not len(size):
        return []
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    left, out, mark = np.arange(len(sets)), [], np.zeros(len(known), dtype=bool)
    ends = np.cumsum(size)
    rest, front = flat, []
    while len(left):
        if front:
            x = front.pop()
        else:
            x, left, rest = left[0], left[1:], rest[size[left[0]] :]
            if not len(left):
                break
        own = flat[ends[x] - size[x] : ends[x]]
        mark[own] = True
        at = np.cumsum(size[left])
        both = np.add.reduceat(mark[rest], at - size[left], dtype=np.int64)
        mark[own] = False
        near = both >= similarity * (size[x] + size[left] - both) - 1e-9
        if near.any():
            front += left[near].tolist()
            out += [(fps[x], fps[k]) for k in left[near]]
            rest = rest[np.repeat(~near, size[left])]
            left = left[~near]
    return out


GROUP_SCHEMA = "row long, key long, i int, j int, g int"


def _groups(most: int):
    """Rows sorted by (key, i, j): the members of each run that bit planes link, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in simhash.merged_runs(batches, ["key", "i", "j"], simhash.MERGED):
            edges = simhash.forest(table["sim"].to_numpy().view("<u8"), most, number)
            group = np.full(table.num_rows, -1, dtype=np.int32)
            for root, k in edges:
                group[root] = group[k] = root
            kept = table.select(["row", "key", "i", "j"]).append_column("g", pa.array(group)).filter(pa.array(group >= 0))
            yield from kept.combine_chunks().to_batches()

    return run


def _links(similarity: float):
    """Rows sorted by (key, i, j, g): the forest of each run."""

    def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets, edges = None, [], [], []
        for batch in batches:
            for *head, fp, grams in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "g", "fp", "grams")), strict=True):
                if head != now:
                    edges += forest(fps, sets, similarity)
                    now, fps, sets = head, [], []
                fps.append(fp)
                sets.append(np.frombuffer(grams, dtype="<u4"))
            if len(edges) > 20_000:
                yield batch_of(edges)
                edges = []
        yield batch_of(edges + forest(fps, sets, similarity))

    return run


def prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of every row: doc_id, the mark of its text, a number of its own, the fingerprint and the SimHash of its set, band keys and the set."""
    common.prepare(docs.sparkSession)
    rows = common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), simhash.text_mark().alias("mark"), F.monotonically_increasing_id().alias("row"), "text")
    return common.materialize(rows.mapInArrow(_prints(width), PRINT_SCHEMA), "shingles")


def links(rows: DataFrame, similarity: float = SIMILARITY, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Edges (a, b) whose components are those of all verified candidate pairs between the distinct sets of ``prints``."""
    first = rows.where("n > 0").groupBy("fp").agg(F.min("row").alias("row")).select("row")
    entries = common.materialize(rows.select("row", "fp", "sim", "n", "bands").join(first, "row", "left_semi").select("row", "fp", "sim", "n", F.explode("bands").alias("key")), "bands")
    buckets = entries.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("size"), F.expr("bit_xor(xxhash64(row))").alias("who"), F.sum(F.xxhash64("fp", F.lit(1)) % (1 << 31)).alias("too")).where("members > 1")
    once = buckets.groupBy("who", "too", "members", "size").agg(F.min("key").alias("key"))
    tiles = F.greatest(F.ceil(F.col("members") / tile), F.ceil(F.col("size") / tile_shingles)).cast("int")
    dealt = entries.join(once.select("key", tiles.alias("tiles")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("tiles") - 1), F.col("own")))
    met = dealt.withColumn("other", F.explode(others)).select("row", "sim", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    n = common.parallelism(rows.sparkSession)
    near = met.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_groups(radius(similarity)), GROUP_SCHEMA)
    whole = near.join(rows.select("row", "fp", "grams"), "row").select("key", "i", "j", "g", "fp", "grams")
    runs = whole.repartition(n, "key", "i", "j", "g").sortWithinPartitions("key", "i", "j", "g")
    edges = common.materialize(runs.mapInArrow(_links(similarity), "a long, b long"), "links")
    common.discard(entries)
    return edges


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, that with the least id, with the columns of ``docs``."""
    rows = prints(docs, width)
    return simhash.keep_heads(docs, rows.select("doc_id", "fp", "mark"), links(rows, similarity), rows)
