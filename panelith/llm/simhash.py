"""SimHash near-duplicates with bit-sliced Hamming comparison.

A fingerprint has 64 bits. Equal fingerprints collapse first, so copies cost one row each. Two fingerprints that differ in at most
r bits agree in at least one of r + 1 parts of their bits; only fingerprints that share a part are compared. Keys with more members than
a block holds are cut into blocks and compared block by block, so no pair is lost and no task holds an unbounded group; keys with few members
share a block, where a mask keeps them apart.

Inside a block the fingerprints stand as bit planes; the distances of a batch of queries grow plane by plane in carry-save
counters over machine words, and a block is left once every distance exceeds the radius. Blocks return a spanning forest of
their links, never all pairs.

Edge cases: null or empty texts and texts without words have fingerprint zero and link like any other; repeated rows give
repeated results; a null ``doc_id`` takes the component's id from its other members (null if it has none); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

SEED, SHINGLE, RADIUS, BITS = 42, 3, 2, 64
#: Fingerprints compared at once; larger groups are cut into so large blocks, small ones share a block of up to ``MERGED``.
BLOCK, MERGED, QUERIES = 4096, 512, 256
#: Stands for a null id where the least id is sought.
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text; unsigned."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(x) for x in zip(*(words[k:] for k in range(width)), strict=False)] if len(words) >= width else [b" ".join(words)]
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(grams), 32_768):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[k : k + 32_768]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view("<u8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _with_fingerprint(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([_signed(fingerprint(t.as_py(), width)) for t in batch.column("text")], type=pa.int64())
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [fp], names=[n for n, _ in kept] + ["fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, marked: bool = False) -> DataFrame:
    """doc_id and signed fingerprint of every row, and its ``text_mark`` if asked for."""
    common.prepare(docs.sparkSession)
    more = [text_mark().alias("mark")] if marked else []
    given = common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text")
    return given.mapInArrow(_with_fingerprint(width), "doc_id long, " + "mark long, " * marked + "fp long")


class Planes:
    """Fingerprints stored vertically: one row of packed bits per bit position."""

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        self.words = -(-self.n // 64)
        bits = np.zeros((self.words * 64, BITS), dtype=np.uint8)
        bits[: self.n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
        self.all_or, self.all_and = int(np.bitwise_or.reduce(fps)), int(np.bitwise_and.reduce(fps))

    def within(self, queries: np.ndarray, radius: int, asked: np.ndarray) -> np.ndarray:
        """Packed bits, a row per query: which of the members ``asked`` of it (packed likewise) differ in at most ``radius`` bits."""
        out = asked.copy()
        depth = (radius + 1).bit_length()
        for at in range(0, len(queries), QUERIES):
            q = queries[at : at + QUERIES]
            varies = (self.all_or | int(np.bitwise_or.reduce(q))) ^ (self.all_and & int(np.bitwise_and.reduce(q)))
            left = out[at : at + QUERIES]
            rows = np.flatnonzero(left.any(axis=1))
            counters = [np.zeros((len(rows), self.words), dtype="<u8") for _ in range(depth)]
            open_, q = left[rows], q[rows]
            for seen, bit in enumerate(b for b in range(BITS) if varies >> b & 1):
                if seen % 8 == 0:  # the block is left once every distance exceeds the radius, and so is each query
                    some = open_.any(axis=1)
                    if not some.any():
                        break
                    if some.sum() < 0.5 * len(some):
                        left[rows[~some]] = 0
                        rows, q, open_, counters = rows[some], q[some], open_[some], [c[some] for c in counters]
                carry = self.planes[bit][None, :] ^ (np.uint64(0) - ((q >> np.uint64(bit)) & np.uint64(1)))[:, None]
                carry &= open_
                for c in counters:  # carry-save: sum stays, carry moves up
                    kept = c & carry
                    c ^= carry
                    carry = kept
                open_ &= ~self._exceeds(counters, radius)
            left[rows] = open_
        return out

    @staticmethod
    def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
        """Where the counter is ``radius + 1``; counts rise by one and stop there, so none passes it unseen."""
        hit = None
        for k, c in enumerate(counters):
            x = c if (radius + 1) >> k & 1 else ~c
            hit = x if hit is None else hit & x
        return hit


def _packed(asked: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of whole words."""
    out = np.zeros((asked.shape[0], -(-asked.shape[1] // 64) * 8), dtype=np.uint8)
    bits = np.packbits(asked, axis=1, bitorder="little")
    out[:, : bits.shape[1]] = bits
    return out.view("<u8")


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def forest(fps: np.ndarray, radius: int = RADIUS, run: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges between places of one block that connect each linked group; with ``run``, only places of one run are compared."""
    n = len(fps)
    later = np.triu(np.ones((n, n), dtype=bool), 1)
    if run is not None:
        later &= run[:, None] == run[None, :]
    near = Planes(fps).within(fps, radius, _packed(later))
    if not near.any():
        return []
    near = _unpacked(near, n)
    near |= near.T
    alone = ~near.any(axis=1)
    seen, out = alone.copy(), []
    for root in np.flatnonzero(~alone).tolist():
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[front] = True
            out += [(root, int(k)) for k in front]
    return out


def cross_forest(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that connect each linked group across two blocks; links inside either block are left to ``forest``."""
    near, out = Planes(b).within(a, radius, _packed(np.ones((len(a), len(b)), dtype=bool))), []
    left = near.any(axis=1)
    for root in range(len(a)):
        if not left[root]:
            continue
        reach, rows = near[root].copy(), np.array([root])
        while True:
            more = np.flatnonzero(left & (near & reach[None, :]).any(axis=1))
            wider = np.bitwise_or.reduce(near[more], axis=0)
            rows = more
            if (wider == reach).all():
                break
            reach = wider
        left[rows] = False
        left[root] = False
        hit = np.flatnonzero(_unpacked(reach, len(b)))
        out += [(int(a[root]), int(b[k])) for k in hit] + [(int(a[k]), int(b[hit[0]])) for k in rows if k != root]
    return out


BLOCK_SCHEMA = "a long, b long, key long, tile int, members binary"


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "key", "tile", "members"])


def merged_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole runs of equal ``keys``, with the number of each row's run; several runs share a table up to ``most`` rows."""
    wait: list[pa.RecordBatch] = []
    rows, last = 0, None

    def number(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        run = number(table)
        starts = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
        for at, to in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(k)[at].as_py() for k in keys)
            if wait and key != last and rows + to - at > most:
                whole = pa.Table.from_batches(wait).combine_chunks()
                yield whole, number(whole)
                wait, rows = [], 0
            wait.append(batch.slice(at, to - at))
            rows, last = rows + to - at, key
    if wait:
        whole = pa.Table.from_batches(wait).combine_chunks()
        yield whole, number(whole)


def _blocks(radius: int):
    """Rows sorted by (key, tile): links inside each run, and the run itself if its key has more blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for table, number in merged_runs(batches, ["key", "tile"], MERGED):
            fps = table["fp"].to_numpy()
            rows += [(int(fps[i]), int(fps[j]), None, None, None) for i, j in forest(fps.view("<u8"), radius, number)]
            tiles = table["tiles"].to_numpy()
            for at in np.flatnonzero(np.diff(number, prepend=-1) & (tiles > 1)).tolist():
                rows.append((None, None, table["key"][at].as_py(), table["tile"][at].as_py(), fps[number == number[at]].astype("<i8").tobytes()))
            if len(rows) > 20_000:
                yield _block_batch(rows)
                rows = []
        yield _block_batch(rows)

    return run


def _cross(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += cross_forest(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), radius)
            yield pa.RecordBatch.from_arrays([pa.array([_signed(e[k]) for e in out], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def part_keys(radius: int):
    """The keys of a fingerprint: its bits in radius + 1 parts. Two that differ in at most ``radius`` bits agree in one of them."""
    ends = [BITS * k // (radius + 1) for k in range(radius + 2)]
    parts = [F.shiftrightunsigned(F.shiftleft("fp", BITS - to), BITS - to + at) if to - at < BITS else F.col("fp") for at, to in zip(ends, ends[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(k), part) for k, part in enumerate(parts)])


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``fp``."""
    spark = fps.sparkSession
    n = common.parallelism(spark)
    # unequal parts of one hash meet in a block for nothing; no pair is missed
    entries = fps.select("fp", F.explode(part_keys(radius)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / block).cast("int")
    shared = entries.join(sizes, "key").select("key", "fp", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    dealt = shared.repartition(n, "key", "tile").sortWithinPartitions("key", "tile")
    found = common.materialize(dealt.mapInArrow(_blocks(radius), BLOCK_SCHEMA), "blocks")
    parts = found.where("members is not null")
    across = parts.alias("x").join(parts.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") < F.col("y.tile")))
    crossed = across.select(F.col("x.members").alias("x"), F.col("y.members").alias("y")).repartition(n, F.xxhash64("x", "y")).mapInArrow(_cross(radius), "a long, b long")
    edges = common.materialize(found.where("members is null").select("a", "b").unionAll(crossed), "links")
    common.discard(found)
    return edges


def classes(rows: DataFrame, radius: int = RADIUS, edges: DataFrame | None = None) -> DataFrame:
    """Per distinct fingerprint of ``rows`` (doc_id, fp): its least id and that of its component (``NO_ID`` for null), and how many rows have it.

    ``mark`` is that of the row with the least id, if ``rows`` have one; ``edges`` between fingerprints are those of ``links`` unless they are given.
    """
    mark = F.col("mark") if "mark" in rows.columns else F.lit(0)
    own = common.materialize(rows.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), mark.alias("mark"))).alias("least"), F.count("*").alias("copies")), "classes")
    own = own.select("fp", F.col("least.id").alias("least_id"), F.col("least.mark").alias("mark"), "copies")
    edges = links(own.select("fp"), radius) if edges is None else edges
    roots = common.materialize(connected_components(edges).withColumnRenamed("v", "fp"), "roots")
    common.discard(edges)
    linked = own.join(roots, "fp")
    best = linked.groupBy("root").agg(F.min(F.struct("least_id", "fp")).alias("best"))
    named = roots.join(best, "root").select("fp", F.col("best.least_id").alias("component"), F.col("best.fp").alias("head"))
    return own.join(named, "fp", "left").select("fp", "least_id", "mark", "copies", F.coalesce("component", "least_id").alias("component"), F.coalesce("head", "fp").alias("head"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = common.materialize(fingerprints(docs), "fingerprints")
    named = common.materialize(classes(rows, radius), "named")
    out = common.look_up(rows, named.select("fp", "copies", "component"), ["fp"], "copies", rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif("component", F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group, that with the least id, with the columns of ``docs``; of rows that share it, that with the least mark."""
    rows = common.materialize(fingerprints(docs, marked=True), "fingerprints")
    return keep_heads(docs, rows, links(rows.select("fp").distinct(), radius), rows)


def text_mark():
    """Tells rows of one id apart by their texts."""
    return F.xxhash64("text")


def keep_heads(docs: DataFrame, rows: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` keeps, if ``rows`` (doc_id, fp, mark) are linked by ``edges``. The table ``done`` goes.

    Whole rows are shuffled once, by id and mark. Of rows equal in both the one with the least hash stays."""
    heads = common.materialize(classes(rows, edges=edges).where("fp = head").select("least_id", F.col("mark").alias("least_mark")), "heads")
    common.discard(done)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_mark().alias("mark"))
    kept = whole.join(heads, (F.col("id") == F.col("least_id")) & (F.col("mark") == F.col("least_mark")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.xxhash64(F.to_json("row"))))
    return kept.withColumn("n", first).where("n = 1").select("row.*")
