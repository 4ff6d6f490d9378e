"""Language-model scoring by prediction by partial matching (PPM) over all byte contexts of the training documents.

A text is its words in lower case, joined by single spaces, and an end byte. The model counts which byte follows which context of
up to ``ORDER`` bytes in all training documents; no count is dropped, so it grows with the corpus. Escape estimation is PPM method C:
a context with ``d`` continuations and total ``t`` gives each of them ``c / (t + d)`` and the rest to the next shorter context, where
the symbols of the longer one are excluded. Below the empty context every byte that is left is equally likely, so each text has a
proper probability.

The model is never in one place. Documents are read once and cut into chunks of about ``CHUNK`` bytes; a chunk asks for its distinct
(ORDER + 1)-grams, with their counts in its training documents. Requests are dealt into buckets by the last ``NEAR`` bytes of the
context, so a bucket sees all counts of the longer contexts it is asked for; what follows shorter contexts is shared, at most
``256**NEAR`` counts whatever the corpus. A bucket answers each request in the order it came, and the chunk, which was kept in the
shared folder, meets its answers. A task holds one chunk, or one bucket: its distinct grams with their counts, and the requests as they came, packed.
There are up to ``MAX_BUCKETS`` buckets; beyond that their grams grow with the corpus, as far as new ones come up.

The base score is an add-half unigram model of words. Words that hold more than one part in ``2**HOT_BITS`` of all training tokens, at most
``2**HOT_BITS`` of them, are scored where the text is read. The others are counted per document and joined with their counts;
none of them is frequent enough to make a join key hot.

Edge cases: a null or empty text has the end token only; without training rows every count is zero; repeated rows and null ids are
scored like any other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import _LOWER as LOWER

ORDER, NEAR, HOT_BITS = 6, 3, 18
FOLDS, HELD_OUT = 5, 1
END = 10
#: Bytes of text whose grams are asked for together, and of text in one row of the shared folder.
CHUNK, PIECE = 8 << 20, 1 << 20
MAX_BUCKETS = 1024


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of the windows of ``order + 1`` bytes; the context before a text is its end byte, repeated."""
    padded = np.concatenate([np.full(order, END, dtype=np.uint8), data]).astype(np.int64)
    n = len(data)
    code = np.zeros(n, dtype=np.int64)
    for k in range(order + 1):
        code = (code << 8) | padded[k : k + n]
    return code


def suffix_codes(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """As ``grams``, but the context's last byte comes first and the byte that follows it last: contexts with a common end are neighbours."""
    padded = np.concatenate([np.full(order, END, dtype=np.uint8), data])
    n = len(data)
    code = np.zeros(n, dtype=np.int64)
    for k in [*range(order - 1, -1, -1), order]:
        code <<= 8
        code |= padded[k : k + n]
    return code


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)


def _by_bucket(codes: np.ndarray, buckets: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted distinct codes bucket by bucket, and where each bucket begins in it."""
    mixed = ((codes >> 8 * (order + 1 - NEAR)) * 0x9E3779B1 >> 16 & 0xFFFFFF) % buckets
    return np.argsort(mixed.astype(np.uint16), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(mixed, minlength=buckets))])


def _packed(*arrays: np.ndarray) -> bytes:
    """Byte plane by byte plane, which compresses well."""
    return pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    flat, out, at = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd", asbytes=True), dtype=np.uint8), [], 0
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    return out


READ_SCHEMA = "kind int, chunk long, bucket int, n long, data binary, ids array<long>, rows array<long>, sizes array<long>, word binary, code long"
_LIST = pa.list_(pa.int64())
_READ_TYPES = {"kind": pa.int32(), "chunk": pa.int64(), "bucket": pa.int32(), "n": pa.int64(), "data": pa.binary(), "ids": _LIST, "rows": _LIST, "sizes": _LIST, "word": pa.binary(), "code": pa.int64()}
WORD, SHORT, REQUEST, TEXT = range(4)


def _read_batch(kind: int, n: int, /, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) if c in columns else pa.nulls(n, t) for c, t in _READ_TYPES.items()], names=list(_READ_TYPES))


def _reader(buckets: int):
    """Of (doc_id, row, train, text): word counts, counts after short contexts, requests and the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words: Counter = Counter()
        docs: list[tuple] = []
        size = 0

        def chunk() -> Iterator[pa.RecordBatch]:
            name = part << 32 | number
            keys = np.concatenate([suffix_codes(np.frombuffer(t, dtype=np.uint8)) << 1 | (not train) for _, _, train, t in docs])
            keys.sort()
            first = _starts(keys >> 1)
            codes, n = keys[first] >> 1, np.add.reduceat(1 - (keys & 1), first)
            del keys
            short = (codes >> 8 * (ORDER + 2 - NEAR)) << 8 | codes & 255
            by = np.argsort(short)
            at = _starts(short[by])
            sums = np.add.reduceat(n[by], at)
            yield _read_batch(SHORT, len(at), code=short[by][at], n=sums)
            by, edge = _by_bucket(codes, buckets)
            codes, n = codes[by], n[by].astype(np.int32)
            full = np.flatnonzero(edge[1:] > edge[:-1])
            for a in range(0, len(full), 256):
                some = full[a : a + 256]
                data = [_packed(np.diff(codes[edge[b] : edge[b + 1]], prepend=0), n[edge[b] : edge[b + 1]]) for b in some]
                yield _read_batch(REQUEST, len(some), chunk=np.full(len(some), name), bucket=some.astype(np.int32), n=edge[some + 1] - edge[some], data=data)
            a = 0
            while a < len(docs):
                b, held = a, 0
                while b < len(docs) and (b == a or held + len(docs[b][3]) <= PIECE):
                    held += len(docs[b][3])
                    b += 1
                ids, rows, _, texts = zip(*docs[a:b], strict=True)
                data = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
                yield _read_batch(TEXT, 1, chunk=[name], n=[held], data=[data], ids=[list(ids)], rows=[list(rows)], sizes=[[len(t) for t in texts]])
                a = b

        def counted() -> pa.RecordBatch:
            return _read_batch(WORD, len(words), word=list(words), n=list(words.values()))

        for batch in batches:
            for doc_id, row, train, cell in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                own = normal_words(cell.as_py())
                if train:
                    words.update(own)
                    words[b""] += 1  # the end
                    if len(words) > 300_000:
                        yield counted()
                        words.clear()
                docs.append((doc_id, row, train, b" ".join(own) + b"\n"))
                size += len(docs[-1][3])
                if size >= CHUNK:
                    yield from chunk()
                    docs, size, number = [], 0, number + 1
        if docs:
            yield from chunk()
        yield counted()

    return run


class Near:
    """All counts of what follows contexts of fewer than ``NEAR`` bytes: levels[k] has the nodes of k context bytes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.levels = {NEAR - 1: (codes, n)}
        for k in range(NEAR - 2, -1, -1):
            self.levels[k] = shorter(*self.levels[k + 1])


def shorter(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of contexts of one byte less: the oldest byte, which stands before the symbol, goes."""
    less = (codes >> 16) << 8 | codes & 255
    by = np.argsort(less, kind="stable")
    at = _starts(less[by])
    return less[by][at], np.add.reduceat(n[by], at) if len(at) else n


def _find(known: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(want), dtype=np.int64), np.zeros(len(want), dtype=bool)
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    return at, known[at] == want


def log10_of(codes: np.ndarray, n: np.ndarray, near: Near) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context.

    ``codes`` are sorted and distinct; ``n`` counts them in training and may be 0. They hold every gram whose context ends in the
    same ``NEAR`` bytes as one of them. What a context has seen, its shorter ones have seen too, so what is excluded from a
    context is what the next longer one holds.
    """
    levels = {ORDER: (codes[n > 0], n[n > 0])}
    for k in range(ORDER - 1, NEAR - 1, -1):
        levels[k] = shorter(*levels[k + 1])
    levels |= near.levels
    out, done = np.zeros(len(codes)), np.zeros(len(codes), dtype=bool)
    gone, fewer = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)  # excluded counts and symbols
    symbol = codes & 255
    for k in range(ORDER, -1, -1):
        nodes, counts = levels[k]
        first = _starts(nodes >> 8)
        contexts, distinct = (nodes >> 8)[first], np.diff(np.append(first, len(nodes)))
        total = np.add.reduceat(counts, first) if len(first) else counts
        want = codes >> 8 * (ORDER - k + 1)
        at, known = _find(contexts, want)
        if not len(contexts):
            continue
        left, kinds = total[at] - gone, distinct[at] - fewer
        escape = np.where(distinct[at] == 256, 0, kinds)
        node, seen = _find(nodes, want << 8 | symbol)
        live = known & ~done & (kinds > 0)
        hit, miss = live & seen, live & ~seen
        out[hit] += np.log10(counts[node[hit]] / (left + escape)[hit])
        out[miss] += np.log10(escape[miss] / (left + escape)[miss])
        done |= hit
        fewer = np.where(known, distinct[at], 0)
        if k:
            below, weight = levels[k - 1]
            there, _ = _find(below, (nodes >> 16) << 8 | nodes & 255)
            gone = np.where(known, np.add.reduceat(weight[there], first)[at], 0)
    out[~done] -= np.log10(256 - fewer[~done])
    return out


class Sums:
    """Distinct grams of a bucket and their counts, added up while requests come: never more than twice the distinct ones are held."""

    def __init__(self):
        self.codes, self.n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        self._waiting.append((codes, n))
        self._size += len(codes)
        if self._size > max(len(self.codes), 1 << 18):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if self._waiting:
            both = np.concatenate([self.codes, *(c for c, _ in self._waiting)])
            by = np.argsort(both, kind="stable")
            first = _starts(both[by])
            self.n = np.add.reduceat(np.concatenate([self.n, *(x.astype(np.int64) for _, x in self._waiting)])[by], first)
            self.codes, self._waiting, self._size = both[by][first], [], 0
        return self.codes, self.n


ANSWER_SCHEMA = "chunk long, bucket int, data binary, n long"


def _answers(shared):
    """Requests sorted by bucket: per request the log10 probabilities in its order."""

    def finish(bucket: int, asked: list[tuple], sums: Sums, near: Near) -> Iterator[pa.RecordBatch]:
        codes, n = sums.done()
        cost = log10_of(codes, n, near).astype(np.float32)
        for a in range(0, len(asked), 64):
            some = asked[a : a + 64]
            data = [_packed(cost[np.searchsorted(codes, np.cumsum(_unpacked(x, n, "<i8", "<i4")[0]))]) for _, n, x in some]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some]), pa.array([bucket] * len(some), type=pa.int32()), pa.array(data, type=pa.binary()), pa.array([x[1] for x in some])], names=["chunk", "bucket", "data", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near(*shared.value)
        now, asked, sums = None, [], Sums()
        for batch in batches:
            for bucket, chunk, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now and asked:
                    yield from finish(now, asked, sums, near)
                    asked, sums = [], Sums()
                now = bucket
                step, count = _unpacked(data, n, "<i8", "<i4")
                sums.add(np.cumsum(step), count)
                asked.append((chunk, n, data))  # as it came, packed
        if asked:
            yield from finish(now, asked, sums, near)

    return run


class Words:
    def __init__(self, hot: dict[bytes, int], tokens: int, distinct: int):
        self.hot, self.tokens, self.distinct = hot, tokens, distinct

    def base(self, count: int) -> float:
        return math.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


SCORED_SCHEMA = "doc_id long, row long, n_tokens long, hot_known long, hot_base double, score double, rare array<struct<word: binary, n: int>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))


def _scorer(shared, buckets: int):
    """Rows sorted by chunk, answers before texts and in order of buckets."""

    def finish(costs: list[np.ndarray], docs: list[tuple], hot: dict[bytes, float], unseen: float) -> Iterator[pa.RecordBatch]:
        codes, place = np.unique(np.concatenate([suffix_codes(np.frombuffer(t, dtype=np.uint8)) for _, _, t in docs]), return_inverse=True)
        by, _ = _by_bucket(codes, buckets)
        cost = np.empty(len(codes))
        cost[by] = np.concatenate(costs)  # of another length if an answer were missing
        lengths = np.array([len(t) for _, _, t in docs])
        score = np.add.reduceat(cost[place], np.cumsum(lengths) - lengths)
        del place
        end_known, end_base = (1, hot[b""]) if b"" in hot else (0, unseen)  # no training rows, no end
        for a in range(0, len(docs), 1000):
            rows = []
            for doc_id, row, text in docs[a : a + 1000]:
                words = text.split()
                known, base, rare = end_known, end_base, []
                for w, n in Counter(words).items():
                    b = hot.get(w)
                    if b is None:
                        rare.append({"word": w, "n": n})
                    else:
                        known += n
                        base += n * b
                rows.append((doc_id, row, len(words) + 1, known, base, rare))
            cols = list(zip(*rows, strict=True))
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.int64()) for c in cols[:4]), pa.array(cols[4], type=pa.float64()), pa.array(score[a : a + 1000]), pa.array(cols[5], type=_RARE)], names=["doc_id", "row", "n_tokens", "hot_known", "hot_base", "score", "rare"])
            yield batch.filter(pc.is_valid(batch.column("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hot, unseen = {w: model.base(c) for w, c in model.hot.items()}, model.base(0)
        now, costs, docs = None, [], []
        for batch in batches:
            for kind, chunk, n, data, ids, rows, sizes in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                if chunk != now and docs:
                    yield from finish(costs, docs, hot, unseen)
                    costs, docs = [], []
                now = chunk
                if kind == REQUEST:
                    costs += _unpacked(data, n, "<f4")
                    continue
                text, at = pa.decompress(data, n, codec="zstd", asbytes=True), 0
                for doc_id, row, size in zip(ids, rows, sizes, strict=True):
                    docs.append((doc_id, row, text[at : at + size]))
                    at += size
        if docs:
            yield from finish(costs, docs, hot, unseen)

    return run


def score(docs: DataFrame, train_docs: DataFrame | None = None, hot_bits: int = HOT_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``train_docs`` defaults to the rows of ``docs`` whose fold is not the held-out one.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    parts = common.parallelism(spark)
    buckets = min(2 * parts, MAX_BUCKETS)
    train = common.doc_fold("doc_id", FOLDS) != HELD_OUT if train_docs is None else F.lit(False)
    rows = common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), train.alias("train"), "text")
    if train_docs is not None:  # without a row number: counted, not scored
        rows = rows.unionAll(common.pick(train_docs, ["text"]).select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True), "text"))
    read = common.materialize(rows.mapInArrow(_reader(buckets), READ_SCHEMA), "lm-read")
    words = common.materialize(read.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_hot = (F.col("n") > tokens >> hot_bits) | (F.col("word") == F.lit(b""))
    model = Words({bytes(r["word"]): r["n"] for r in words.where(is_hot).collect()}, tokens, distinct)
    rare_counts = words.where(~is_hot).select("word", F.col("n").alias("c"))
    short = read.where(F.col("kind") == SHORT).groupBy("code").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    by = np.argsort(short["code"].to_numpy())
    near = spark.sparkContext.broadcast((short["code"].to_numpy()[by].astype(np.int64), short["n"].to_numpy()[by].astype(np.int64)))
    requests = read.where(F.col("kind") == REQUEST).select("bucket", "chunk", "n", "data")
    answers = requests.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answers(near), ANSWER_SCHEMA)
    none = F.lit(None).cast("array<long>")
    texts = read.where(F.col("kind") == TEXT).select("kind", "chunk", "bucket", "n", "data", "ids", "rows", "sizes")
    met = answers.select(F.lit(REQUEST).alias("kind"), "chunk", "bucket", "n", "data", none.alias("ids"), none.alias("rows"), none.alias("sizes")).unionAll(texts)
    dealt = met.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    scored = common.materialize(dealt.mapInArrow(_scorer(spark.sparkContext.broadcast(model), buckets), SCORED_SCHEMA), "lm-scored")
    common.discard(read)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    floor = F.lit(model.tokens + 0.5 * (model.distinct + 1))
    c = F.coalesce("c", F.lit(0))
    joined = rare.join(rare_counts, "word", "left").select("row", (F.when(c > 0, F.col("n")).otherwise(0)).cast("long").alias("known"), (F.col("n") * F.log10((c + 0.5) / floor)).alias("base"))
    sums = joined.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"))
    out = scored.drop("rare").join(sums, "row", "left")
    return out.select(
        "doc_id",
        (common.doc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        "score",
    )
