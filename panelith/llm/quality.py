"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; its label says nothing of any single one. Every passage is encoded from its text alone: shares of
letters, digits, blanks and of each sign, the lengths and cases of its words, how many of them differ and how many repeat the word before. A layer
of ``HIDDEN`` units embeds the passages; gated attention, the product of a tanh and a sigmoid layer, gives each passage a weight that is learned from
the documents' labels; the score is a logistic function of the weighted mean of the embedded passages.

The classifier is fitted on a bounded sample: about ``MAX_TRAIN`` labelled documents of the training folds with about ``MAX_PASSAGES``
passages in all, chosen by hashes of id and text; bags of over ``MAX_BAG`` passages are scored but not learned from. A fifth of the
sample is kept apart: the score's offset is set so that the cut which parts its labels best stands at ``CUT``. Scoring reads every whole text,
in pieces of ``CHUNK`` characters whose attention sums are joined, so that memory does not grow with a text. Labels, lang, source
and doc_id are no inputs of a score.

Edge cases: null and empty texts are one passage without words; null labels, labels without a document and ids with contradicting labels
teach nothing; repeated rows get equal scores; with labels of one kind only every score is 1 or 0, without any labels 0.5; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a passage; characters of a text that are encoded at once; passages that are scored at once.
PASSAGE, CHUNK, TOGETHER = 64, 1 << 20, 4096
#: Bounds of the sample that is learned from.
MAX_TRAIN, MAX_PASSAGES, MAX_BAG = 8000, 150_000, 1024
FOLDS, HELD_OUT, CUT = 4, 2, 0.7
HIDDEN, GATE = 24, 12
EPOCHS, BAGS, RATE, DECAY = 40, 64, 5e-3, 1e-4

# Classes of bytes: blanks, line ends, lower case, upper case, digits, parts of other letters, controls, then each sign.
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _OTHER, _CONTROL, _SIGN = range(8)
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = _SIGN + len(_SIGNS)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
_CLASS[:32] = _CONTROL
_CLASS[127] = _CONTROL
_CLASS[[32, 9]] = _SPACE
_CLASS[10:14] = _LINE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[_SIGNS] = np.arange(_SIGN, _CLASSES)
#: Words of up to so many bytes fall into one bin.
_BINS = np.array([1, 2, 3, 4, 6, 8, 11, 15, 22])
_WORDS = ("capital", "shouted", "signed", "distinct", "repeated", "full")
FEATURES = _CLASSES + len(_BINS) + 1 + len(_WORDS)

# Hashes of words are differences of running sums of byte * base ** place; the base is odd and so has an inverse.
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def encode(text: str) -> np.ndarray:
    """A row of features per passage."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kind = _CLASS[raw]
    blank = kind <= _LINE
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.empty(0, dtype=np.int64)
    if not len(start):
        return np.zeros((1, FEATURES), dtype=np.float32)
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    n = len(start)
    passages = -(-n // PASSAGE)
    part = np.zeros(len(raw), dtype=np.int64)
    part[start[PASSAGE::PASSAGE]] = 1
    signs = np.bincount(np.cumsum(part) * _CLASSES + kind, minlength=passages * _CLASSES).reshape(passages, -1)
    of, words = np.arange(n) // PASSAGE, np.minimum(PASSAGE, n - PASSAGE * np.arange(passages))
    bins = np.bincount(of * (len(_BINS) + 1) + np.searchsorted(_BINS, end - start), minlength=passages * (len(_BINS) + 1)).reshape(passages, -1)
    up, down = _places(len(raw))
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    key = (running[end] - running[start]) * down[start]
    case = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (_UPPER, _LOWER)]
    uppers, lowers = (c[end] - c[start] for c in case)
    order = np.lexsort((key, of))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
    again = np.zeros(n, dtype=bool)
    again[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    each = (kind[start] == _UPPER, (uppers > 1) & (lowers == 0), kind[end - 1] >= _SIGN, fresh, again)
    marks = [np.bincount(of[order] if m is fresh else of, weights=m, minlength=passages) / words for m in each]
    return np.column_stack([np.sqrt(signs / signs.sum(axis=1, keepdims=True)), np.sqrt(bins / words[:, None]), *marks, words / PASSAGE]).astype(np.float32)


def _chunks(text: str) -> Iterator[str]:
    """Pieces of whole words, if no word is longer than a piece."""
    at = 0
    while at < len(text) or at == 0:
        to = at + CHUNK
        if to < len(text):
            cut = max(text.rfind(" ", at, to), text.rfind("\n", at, to))
            to = cut if cut > at else to
        yield text[at:to]
        at = to


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Scaling of the features, embedding, gated attention, and the logistic layer."""

    SHAPES = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else rng.normal(0, 0.1, s) if k in "ac" else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.mean, self.scale, self.offset = np.zeros(FEATURES, dtype=np.float32), np.ones(FEATURES, dtype=np.float32), 0.0
        #: A score for all, where there was nothing to learn.
        self.fixed: float | None = None

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Embedded passages, both gates, and the attention's logarithms."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        return h, t, g, (t * g) @ p["a"]

    def pooled(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the bags that begin at ``at``: greatest logarithm, sum of weights, and weighted sum of passages."""
        h, _, _, e = self.attend(x)
        top = np.maximum.reduceat(e, at)
        weight = np.exp(e - np.repeat(top, np.diff(np.append(at, len(x)))))
        return top, np.add.reduceat(weight, at), np.add.reduceat(weight[:, None] * h, at)

    def _finish(self, mean: np.ndarray) -> np.ndarray:
        return _sigmoid((mean @ self.p["c"] + self.p["d"]).astype(np.float64) + self.offset)

    def score_bags(self, bags: Sequence[np.ndarray]) -> np.ndarray:
        at = np.cumsum([0, *(len(b) for b in bags[:-1])])
        _, weight, total = self.pooled(np.concatenate(bags), at)
        return self._finish(total / weight[:, None])

    def score_long(self, text: str) -> float:
        """A text in pieces: their attention sums are joined at a common greatest logarithm."""
        top, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for piece in _chunks(text):
            t, w, s = (v[0] for v in self.pooled(encode(piece), np.zeros(1, dtype=np.int64)))
            new = max(top, float(t))
            old_by, by = np.exp(top - new), np.exp(float(t) - new)
            top, weight, total = new, weight * old_by + float(w) * by, total * old_by + s * by
        return float(self._finish(total / weight))

    def score(self, texts: Sequence[str | None]) -> list[float]:
        if self.fixed is not None:
            return [self.fixed] * len(texts)
        out, bags, places, size = [0.0] * len(texts), [], [], 0

        def flush() -> None:
            for k, s in zip(places, self.score_bags(bags) if bags else (), strict=True):
                out[k] = float(s)

        for k, text in enumerate(texts):
            if text and len(text) > CHUNK:
                out[k] = self.score_long(text)
                continue
            bags.append(encode(text or ""))
            places.append(k)
            size += len(bags[-1])
            if size >= TOGETHER:
                flush()
                bags, places, size = [], [], 0
        flush()
        return out

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over bags."""
        p, n = self.p, np.diff(np.append(at, len(x)))
        h, t, g, e = self.attend(x)
        weight = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        weight /= np.repeat(np.add.reduceat(weight, at), n)
        z = np.add.reduceat(weight[:, None] * h, at)
        err = ((_sigmoid(z @ p["c"] + p["d"]) - y) / len(y)).astype(np.float32)
        dz = err[:, None] * p["c"]
        each = np.repeat(dz, n, axis=0)
        gain = (each * h).sum(axis=1)
        de = weight * (gain - np.repeat(np.add.reduceat(weight * gain, at), n))
        dgate = de[:, None] * p["a"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = (weight[:, None] * each + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ err, "d": err.sum()}

    def fit(self, bags: Sequence[np.ndarray], labels: Sequence[int], epochs: int = EPOCHS, seed: int = 11) -> Model:
        """Adam on small groups of bags; a fifth of the bags sets the offset."""
        y = np.array(labels, dtype=np.float32)
        if len(set(labels)) < 2:
            self.fixed = float(y[0]) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(bags))
        apart, learned = order[: len(bags) // 5], order[len(bags) // 5 :]
        if len(set(y[learned])) < 2:
            learned = order
        whole = np.concatenate([bags[k] for k in learned])
        self.mean, self.scale = whole.mean(axis=0), whole.std(axis=0) + np.float32(0.02)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            rng.shuffle(learned)
            for b in range(0, len(learned), BAGS):
                group, step = learned[b : b + BAGS], step + 1
                held = [bags[k] for k in group]
                grad = self.gradients(np.concatenate(held), np.cumsum([0, *(len(x) for x in held[:-1])]), y[group])
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k, v in grad.items():
                    v = v + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        judged = apart if len(set(y[apart])) == 2 else order
        score = np.concatenate([self.score_bags([bags[k] for k in judged[b : b + BAGS]]) for b in range(0, len(judged), BAGS)])
        logit = np.log(np.clip(score, 1e-9, 1 - 1e-9) / (1 - np.clip(score, 1e-9, 1 - 1e-9)))
        self.offset = float(np.log(CUT / (1 - CUT)) - best_cut(logit, y[judged]))
        return self


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The value that parts the labels with the least sum of both error shares; in the middle of the widest such gap."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    lost = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())  # good ones below the cut
    passed = (np.sum(1 - y) - np.concatenate([[0], np.cumsum(1 - y)])) / max(1, np.sum(1 - y))
    gaps = np.concatenate([[0.0], np.diff(v), [0.0]])
    errors = np.where((gaps > 0) | (np.arange(len(gaps)) == 0), lost + passed, np.inf)
    near = np.flatnonzero(errors <= errors.min() + 1e-12)
    k = near[np.argmax(gaps[near])]
    return float(v[0] - 1 if k == 0 else v[-1] + 1 if k == len(v) else (v[k - 1] + v[k]) / 2)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [[encode(piece) for piece in _chunks(t.as_py() or "")] for t in batch.column(0)]
        sizes = [sum(len(p) for p in b) for b in bags]
        held = [np.concatenate(b).astype("<f2").tobytes() if s <= MAX_BAG else None for b, s in zip(bags, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sizes, type=pa.int64()), pa.array(held, type=pa.binary())], names=["label", "mark", "size", "bag"])


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES) -> tuple[list[np.ndarray], list[int]]:
    """Bags and labels of about ``max_train`` labelled documents of the training folds; each text of an id once."""
    given = labels.select(F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("label")).where("label is not null and lid is not null")
    given = given.where(common.doc_fold("lid", FOLDS) != HELD_OUT).groupBy("lid").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    n = given.count()
    million = 1_000_000
    if n > max_train:
        given = given.where(F.pmod(F.xxhash64("lid"), F.lit(million)) < int(million * max_train / n))
    rows = common.pick(docs, ["doc_id", "text"]).join(F.broadcast(given), F.col("doc_id") == F.col("lid"))
    rows = rows.select("lid", F.xxhash64(common.text_or_empty(), "lid").alias("mark"), "text", "label").dropDuplicates(["lid", "mark"])
    bags = common.materialize(rows.select("text", "label", "mark").mapInArrow(_bags, "label int, mark long, size long, bag binary"), "bags")
    usable = bags.where("bag is not null")
    n, passages = usable.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, 1.2 * max_train / max(1, n), max_passages / max(1, passages))
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("mark"), F.lit(million)) < int(million * share))
    got = sorted((r["mark"], r["label"], bytes(r["bag"])) for r in usable.select("mark", "label", "bag").collect())
    common.discard(bags)
    return [np.frombuffer(b, dtype="<f2").astype(np.float32).reshape(-1, FEATURES) for _, _, b in got], [int(y > 0) for _, y, _ in got]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    common.prepare(docs.sparkSession)
    return Model().fit(*sample(docs, labels, max_train))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), type=pa.float64())], names=["doc_id", "score"])

    return common.pick(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
