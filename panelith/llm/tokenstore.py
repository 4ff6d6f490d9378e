"""Content-addressed store of token ids.

Every document becomes its ids and an end id. A rolling hash over the id stream cuts it into chunks whose borders depend
on the content alone, so that equal passages give equal chunks. The store has three tables under one folder:

* ``data/kind=0``: unique chunks, ``key`` (BLAKE2b-128 of the payload) and ``payload`` (little-endian ids);
* ``recipes``: one row per document in ascending ``doc_id`` (nulls first), with the chunk digests in order, the Merkle root over them,
  the number of ids and where the document starts inside its part;
* ``manifest``: per part the ids before it, the numbers of ids and documents and the Merkle root over its documents' roots in order;
  each row also has the Merkle root over the parts' roots.

Reading verifies each payload against its digest, each document against its Merkle root, and first of all the parts against the manifest.

Edge cases: a null text is empty and holds the end id only; null and repeated ``doc_id`` are kept, one row each, ordered
by their Merkle root inside a tie; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoder import encoder

DIGEST = 16
#: Ids that a border's hash looks back on; one border in 256 positions; least and greatest length of a chunk.
WINDOW, MASK, LEAST, MOST = 8, 0xFF, 64, 1024
#: Digests a task remembers so that it sends a chunk to the shuffle once; the store is exact whatever it forgets.
SEEN = 400_000

DATA_SCHEMA = "kind int, key binary, payload binary, doc_id long, n_ids long, digests binary"
RECIPE_SCHEMA = "doc_id long, part int, local_start long, n_ids long, root binary, digests binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the leaves; a last leaf without partner moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        up = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = up + leaves[len(leaves) & ~1 :]
    return leaves[0]


def candidates(ids: np.ndarray) -> np.ndarray:
    """Positions behind which the rolling hash of the last ``WINDOW`` ids asks for a border.

    Whole batches of documents may be passed at once: a border within the first ``LEAST`` ids of a document, where the window would reach
    into the one before, is never taken.
    """
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = mixed.copy()
    for k in range(1, WINDOW):
        rolled[k:] += mixed[:-k] << np.uint64(k)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(((rolled >> np.uint64(48)) & np.uint64(MASK)) == 0) + 1


def borders(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids with the given candidates."""
    out, last = [], 0
    for b in at:
        while b - last > MOST:
            last += MOST
            out.append(last)
        if b - last >= LEAST:
            out.append(b)
            last = b
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunker(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        width, end = enc.dtype.itemsize, np.array([end_id], dtype=enc.dtype)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            coded = enc.encode_all(batch.column(1).to_pylist())
            stream = np.concatenate([x for ids in coded for x in (ids, end)]) if coded else end[:0]
            cuts, at, begin = candidates(stream), 0, 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                n = len(ids) + 1
                until = int(np.searchsorted(cuts, begin + n, side="right"))
                raw, last, keys = stream[begin : begin + n].tobytes(), 0, []
                for b in borders(n, (cuts[at:until] - begin).tolist()):
                    payload = raw[last * width : b * width]
                    keys.append(key := digest(payload))
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append((0, key, payload, None, None, None))
                        size += len(payload)
                    last = b
                begin, at = begin + n, until
                joined = b"".join(keys)
                rows.append((1, merkle(keys), None, doc_id, n, joined))
                size += len(joined)
                if size > 4_000_000:
                    yield _data_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _data_batch(rows)

    return run


def _data_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = ("kind", "key", "payload", "doc_id", "n_ids", "digests")
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _first_of_each(rows: DataFrame) -> DataFrame:
    """One row of each chunk and every recipe, whose ``own`` numbers differ; one sort behind one shuffle, which may spill."""
    once = Window.partitionBy("key", "own").orderBy("key")
    dealt = rows.withColumn("own", F.when(F.col("kind") == 1, F.monotonically_increasing_id()).otherwise(-1))
    dealt = dealt.repartition(common.parallelism(rows.sparkSession), "key", "own")
    return dealt.withColumn("copy", F.row_number().over(once)).where("copy = 1").drop("own", "copy")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the ids before each document inside its part; the rows come in order."""
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.array(batch.column("n_ids").to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = start + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(ends - n), batch.column("n_ids"), batch.column("key"), batch.column("digests")],
            names=["doc_id", "part", "local_start", "n_ids", "root", "digests"],
        )
        start = int(ends[-1]) if len(ends) else start


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Writes the store of ``docs`` (doc_id, text) to ``path``."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunker(tokenizer_path, end_id), DATA_SCHEMA)
    _first_of_each(rows).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    recipes = spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data").where("kind = 1")
    ordered = recipes.select("doc_id", "n_ids", "key", "digests").repartitionByRange(common.parallelism(spark), F.asc_nulls_first("doc_id"), "key")
    ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "key").mapInArrow(_place, RECIPE_SCHEMA).write.parquet(f"{path}/recipes")
    # one row per part, however many documents
    parts, before = _parts(spark, path), 0
    store, rows = merkle([r[3] for r in parts]), []
    for part, n_ids, n_docs, root in parts:
        rows.append((part, n_ids, n_docs, root, before, store))
        before += n_ids
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{path}/manifest")


MANIFEST_SCHEMA = "part int, n_ids long, n_docs long, root binary, before long, store binary"


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and place: one row per part with the Merkle root over its documents' roots."""
    now, n_ids, leaves, out = None, 0, [], []
    for batch in batches:
        for part, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_ids", "root")), strict=True):
            if part != now:
                if leaves:
                    out.append((now, n_ids, len(leaves), merkle(leaves)))
                now, n_ids, leaves = part, 0, []
            n_ids += n
            leaves.append(root)
    if leaves:
        out.append((now, n_ids, len(leaves), merkle(leaves)))
    cols, types = zip(*out, strict=True) if out else ((),) * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["part", "n_ids", "n_docs", "root"])


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int, int, bytes]]:
    """Part, ids, documents and Merkle root of each part, as its recipes have them now."""
    docs = spark.read.schema(RECIPE_SCHEMA).parquet(f"{path}/recipes").select("part", "local_start", "n_ids", "root")
    ordered = docs.repartition(common.parallelism(spark), "part").sortWithinPartitions("part", "local_start")
    found = ordered.mapInArrow(_part_roots, "part int, n_ids long, n_docs long, root binary").collect()
    return sorted((r["part"], r["n_ids"], r["n_docs"], bytes(r["root"])) for r in found)


def verify_parts(spark: SparkSession, path: str) -> None:
    """Raises ValueError if a recipe or a part is missing, too many or another than the manifest says."""
    manifest = sorted((tuple(r) for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").collect()), key=lambda r: r[0])
    found, said = {r[0]: r for r in _parts(spark, path)}, {r[0]: (*r[:3], bytes(r[3])) for r in manifest}
    for part in sorted(found.keys() | said.keys()):
        if found.get(part) != said.get(part):
            raise ValueError(f"part {part} does not match the manifest")
    store = merkle([r[3] for _, r in sorted(said.items())])
    if len(said) != len(manifest) or any(bytes(r[5]) != store for r in manifest):
        raise ValueError("the manifest does not match its Merkle root")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the store: doc_id, start, n_ids, root, digests, part, local_start. Checked against the manifest at once."""
    verify_parts(spark, path)
    docs = spark.read.schema(RECIPE_SCHEMA).parquet(f"{path}/recipes")
    parts = spark.read.schema("part int, before long").parquet(f"{path}/manifest")
    return docs.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("local_start"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data").where("kind = 0").select("key", "payload")


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).to_pylist()
            for key, payload in zip(batch.column(0).to_pylist(), payloads, strict=True):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
            wide = memoryview(np.frombuffer(b"".join(payloads), dtype=f"<u{width}").astype("<u4").tobytes())
            sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads)) // width
            ends = (4 * np.cumsum(sizes)).tolist()
            crcs = [zlib.crc32(wide[e - 4 * n : e]) for e, n in zip(ends, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(crcs, type=pa.int64())], names=["key", "n", "crc"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a document; checks the Merkle root."""
    for batch in batches:
        joined = batch.column("digests").to_pylist()
        for doc_id, root, digests in zip(batch.column("doc_id").to_pylist(), batch.column("root").to_pylist(), joined, strict=True):
            if merkle([digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]) != root:
                raise ValueError(f"document {doc_id} does not match its Merkle root")
        many = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)) // DIGEST
        row = np.repeat(np.arange(len(many)), many)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(row), [None, pa.py_buffer(b"".join(joined))]).cast(pa.binary())
        given = batch.select(["part", "local_start", "doc_id", "start", "n_ids"]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*given.columns, pa.array(pos.astype(np.int32)), keys], names=[*given.schema.names, "pos", "key"])


ENTRY_SCHEMA = "part int, local_start long, doc_id long, start long, n_ids long, pos int, key binary"


def _zero_operators() -> np.ndarray:
    """Table k, byte b, value v: what v in byte b of a CRC-32 becomes when 2**k zero bytes are appended."""

    def times(matrix: list[int], vector: int) -> int:
        total = 0
        for k in range(32):
            if vector >> k & 1:
                total ^= matrix[k]
        return total

    one = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        one = [times(one, c) for c in one]
    tables = np.zeros((48, 4, 256), dtype=np.uint32)
    for table in tables:
        for b in range(4):
            for k in range(8):
                table[b, np.arange(256) >> k & 1 == 1] ^= np.uint32(one[8 * b + k])
        one = [times(one, c) for c in one]
    return tables


_ZEROS: list[np.ndarray] = []


def crc_shift(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of each CRC-32 in that of a text which goes on for so many bytes behind it; the parts of a text's pieces are joined by xor."""
    if not _ZEROS:
        _ZEROS.append(_zero_operators())
    crcs, k = crcs.astype(np.uint32), 0
    while len(zeros) and int(zeros.max()) >> k:
        on = np.flatnonzero(zeros >> k & 1)
        c, t = crcs[on], _ZEROS[0][k]
        crcs[on] = t[0][c & 0xFF] ^ t[1][c >> 8 & 0xFF] ^ t[2][c >> 16 & 0xFF] ^ t[3][c >> 24]
        k += 1
    return crcs


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and position: one row per document. The last document of a batch waits for the next one."""
    wait: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, local, n_ids, n, crc = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "local_start", "n_ids", "n", "crc"))
        first = np.concatenate([[True], (part[1:] != part[:-1]) | (local[1:] != local[:-1])])
        at = np.flatnonzero(first)
        doc = np.cumsum(first) - 1
        done = np.cumsum(n)
        begun = (done - n)[at]  # ids of the batch before each document
        key, had, mixed = (int(part[0]), int(local[0])), 0, 0
        if wait and wait[0] == key:
            _, _, had, mixed = wait
        elif wait:
            yield _whole(*wait[1:])
        before = np.zeros(len(at), dtype=np.int64)
        before[0] = had
        total = before + np.add.reduceat(n, at)
        after = n_ids - (before[doc] + done - begun[doc])
        if (after < 0).any():
            raise ValueError("a document has more ids than its recipe says")
        joined = np.bitwise_xor.reduceat(crc_shift(crc, 4 * after), at)
        joined[0] ^= np.uint32(mixed)
        facts = batch.select(["doc_id", "start", "n_ids"]).take(pa.array(at))
        last = len(at) - 1
        if last:
            yield _whole(facts.slice(0, last), total[:last], joined[:last])
        wait = (int(part[-1]), int(local[-1])), facts.slice(last), int(total[last]), int(joined[last])
    if wait:
        yield _whole(*wait[1:])


def _whole(facts: pa.RecordBatch, n: np.ndarray | int, crc: np.ndarray | int) -> pa.RecordBatch:
    n, crc = np.atleast_1d(np.asarray(n, dtype=np.int64)), np.atleast_1d(np.asarray(crc)).astype(np.int64)
    if (facts.column("n_ids").to_numpy() != n).any():
        raise ValueError("a document has another number of ids than its recipe says")
    return pa.RecordBatch.from_arrays([facts.column("doc_id"), facts.column("start"), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_checks(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Reads every chunk and recipe back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    common.prepare(spark)
    facts = chunks(spark, path).mapInArrow(_verify(width), "key binary, n long, crc long")
    entries = recipes(spark, path).select("part", "local_start", "doc_id", "start", "n_ids", "root", "digests").mapInArrow(_entries, ENTRY_SCHEMA)
    joined = entries.join(facts, "key", "left").withColumn("n", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("long")))
    by_doc = joined.repartition(common.parallelism(spark), "part", "local_start").sortWithinPartitions("part", "local_start", "pos")
    return by_doc.select("part", "local_start", "doc_id", "start", "n_ids", "n", "crc").mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Reconstructs the id streams: doc_id, start, ids (array of long)."""
    common.prepare(spark)
    entries = recipes(spark, path).select("part", "local_start", "doc_id", "start", "n_ids", "root", "digests").mapInArrow(_entries, ENTRY_SCHEMA)
    whole = entries.join(chunks(spark, path), "key", "left").withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("a chunk is missing")).cast("binary")))
    joined = whole.repartition(common.parallelism(spark), "part", "local_start").sortWithinPartitions("part", "local_start", "pos")

    def rebuild(batches):
        now, state = None, None
        for batch in batches:
            for part, local, doc_id, start, key, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "doc_id", "start", "key", "payload")), strict=True):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
                if (part, local) != now:
                    if state:
                        yield _ids_batch(state, width)
                    now, state = (part, local), [doc_id, start, []]
                state[2].append(payload)
        if state:
            yield _ids_batch(state, width)

    return joined.select("part", "local_start", "doc_id", "start", "key", "payload").mapInArrow(rebuild, "doc_id long, start long, ids array<long>")


def _ids_batch(state: list, width: int) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(state[2]), dtype=f"<u{width}").astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([state[0]], type=pa.int64()), pa.array([state[1]], type=pa.int64()), pa.array([ids], type=pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])
