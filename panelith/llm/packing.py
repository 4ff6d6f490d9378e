"""Best-fit packing of token pieces into sequences.

Bounded-space online best-fit: a packer holds at most ``OPEN_BINS`` open bins, kept by free space; a bitset of the free
spaces in use finds the smallest one that still fits in a few machine operations. When no bin fits and all are open, the
fullest closes. A piece of full length closes its bin at once.

Texts are tokenised once; the lengths (about 40 bytes a piece) are written to the shared folder and packed from there in
few, large shards, each a stream through one packer, so memory is bounded and no shuffle is needed. The stream passes in stretches of
``LOOKAHEAD`` pieces, each in descending length: long pieces open bins that the short ones of the same stretch fill.

Edge cases: a null or empty text has the end id only (length 1); repeated and null ``doc_id`` are packed like any other row;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoder import encoder

#: Bins that may be open at once in a packer.
OPEN_BINS = 4096
#: Pieces that one packer takes; more pieces get more packers.
SHARD_PIECES = 4_000_000
#: Pieces that are looked at together.
LOOKAHEAD = 8192

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long"


class BestFit:
    """Online best-fit over bins of ``capacity``; bins are known by number."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.open, self.bins = 0, 0, 0

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.mask ^= 1 << free
        self.open -= 1
        return b

    def _push(self, b: int, free: int) -> None:
        stack = self.by_free[free]
        if not stack:
            self.mask |= 1 << free
        stack.append(b)
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes the piece and the piece's offset there."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            b, free = self.bins, self.capacity
            self.bins += 1
            if length < self.capacity and self.open >= self.most:
                self._pop((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
        if free > length:
            self._push(b, free - length)
        return b, self.capacity - free


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = []
            for doc_id, coded in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = np.append(coded, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            yield _batch(out, ("doc_id", "piece", "start", "length", "ids_crc32"))

    return run


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if n == "piece" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=list(names))


def _packer(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 33

        def placed(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            lengths = rows["length"].to_numpy()
            order = np.argsort(-lengths, kind="stable")
            bins, offsets = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
            for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
                bins[k], offsets[k] = fit.place(n)
            yield from rows.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).to_batches()

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= LOOKAHEAD:
                yield from placed(waiting)
                waiting, size = [], 0
        if waiting:
            yield from placed(waiting)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Cuts every document's ids into pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32."""
    common.prepare(docs.sparkSession)
    return common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece with the sequence and offset that hold it; ``shard_pieces`` is what a packer gets on average."""
    cut = common.materialize(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    # few files may hold more than a shard each: their rows are dealt out then
    dealt = cut.coalesce(shards) if cut.rdd.getNumPartitions() >= shards else cut.repartition(shards)
    return dealt.mapInArrow(_packer(capacity, open_bins), PACKED_SCHEMA)
