"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters to Latin ones, digits and signs used as letters to those letters (i, l, 1, | and ! are one
class), drops accents and zero-width signs, and keeps words of letters. The lexicon is learned from labelled rows of the
training folds: terms that toxic documents hold far more often, each supported by many *different* neighbourhoods, so that
copies of one document teach nothing. Phrases in which a term occurs in clean documents only are exceptions; a hit
inside one doesn't count. The score is a logistic function of the weight sum and of the weight sum per word.

The classifier is fitted on a bounded sample: about ``MAX_TRAIN`` labelled rows, chosen by hashes of id and text, each text of an id once. Lexicon and
exceptions have no further bound: they hold what is supported often enough in the sample. Scoring reads
every whole text in time linear in its length; labels, lang, source and doc_id are no inputs of a score.

Edge cases: null and empty texts have no hits and take the score of zero weight; null labels and labels without a document are ignored;
repeated rows get equal scores; without labelled rows of both kinds the lexicon is empty and every score is the share of
toxic labels (0 if there are none); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are learned from.
MAX_TRAIN = 20_000
#: A term needs so many different neighbourhoods in toxic documents, a share of its occurrences, and so high log odds.
LEAST_CONTEXTS, LEAST_VARIETY, LEAST_ODDS = 8, 0.5, 2.5
FOLDS = 5

# Letters that look like Latin ones, and signs that stand for letters.
CONFUSABLE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ԛ": "q", "ѡ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "ß": "ss",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i", "+": "t",
}
INVISIBLE = "​‌‍⁠﻿­"


class _Fold(dict):
    """Character by character, filled as characters come up; bounded by the characters that exist."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE or unicodedata.combining(c):
            out = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(CONFUSABLE.get(x, x) for x in plain).replace("l", "i")
            if c in "!|+" :
                out = CONFUSABLE[c]
        self[code] = out
        return out


_FOLD = _Fold()
_LETTERS = re.compile(r"[^\W\d_]+")
_TRAIL = re.compile(r"(?<![!|+$@])[!|+$@]++(?=\s|$)")


def fold(text: str | None) -> list[str]:
    """Folded words of a text. Signs at a word's end are punctuation, inside a word they stand for letters."""
    if not text:
        return []
    return _LETTERS.findall(_TRAIL.sub(" ", text).translate(_FOLD))


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` training rows: text and toxic; the label side is bounded by the sample."""
    given = labels.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and lid is not null")
    given = given.where(common.doc_fold("lid", FOLDS) != 0).groupBy("lid").agg(F.max("toxic").alias("toxic"))
    n = given.count()
    if n > bound:
        given = given.where(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    rows = common.pick(docs, ["doc_id", "text"]).join(F.broadcast(given), F.col("doc_id") == F.col("lid"))
    rows = rows.select("lid", F.xxhash64("text").alias("mark"), "text", "toxic").dropDuplicates(["lid", "mark"])
    return rows


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """The training rows, written once as they are read three times. Ids with many texts are thinned like labels."""
    rows = common.materialize(_labelled(docs, labels, bound), "labelled")
    n = rows.count()
    if n > 1.2 * bound:
        rows = rows.where(F.pmod(F.xxhash64("mark", "lid"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    return rows.select("text", "toxic")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, by label; partial sums."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array([v[1] for v in counts.values()], type=pa.int64()), pa.array([v[0] for v in counts.values()], type=pa.int64())], names=["term", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for w in {*fold(text.as_py()), ""}:
                counts.setdefault(w, [0, 0])[1 if toxic else 0] += 1
        if len(counts) > 200_000:
            yield out()
            counts.clear()
    yield out()


def _neighbourhoods(terms: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = ["", *fold(text.as_py()), ""]
                for k in range(1, len(words) - 1):
                    if words[k] in terms:
                        got[words[k], words[k - 1], words[k + 1], 1 if toxic else 0] += 1
            cols = list(zip(*got, strict=True)) if got else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.string()) for c in cols[:3]), pa.array(cols[3], type=pa.int32()), pa.array(list(got.values()), type=pa.int64())], names=["term", "before", "after", "toxic", "n"])

    return run


class Model:
    """Lexicon, exception phrases and the three coefficients."""

    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str], coefficients: Sequence[float]):
        self.lexicon, self.exceptions, self.coefficients = lexicon, tuple(exceptions), tuple(coefficients)
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.lexicon.items():
                a.add_word(f" {t} ", (len(t) + 2, w))
            for p in self.exceptions:
                if p not in self.lexicon:
                    a.add_word(f" {p} ", (len(p) + 2, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.lexicon, self.exceptions, self.coefficients

    def __setstate__(self, state):
        self.lexicon, self.exceptions, self.coefficients = state
        self._automaton = None

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight sum of the hits outside exceptions, and the same per 100 words; both damped."""
        words = fold(text)
        a = self.automaton()
        if not len(a) or not words:
            return 0.0, 0.0
        hits, free = [], []
        for end, (length, weight) in a.iter(f" {' '.join(words)} "):
            (free if weight is None else hits).append((end - length + 1, end, weight))
        # from the right: of the exceptions that end behind a hit, does the one that begins first begin before it?
        total, first, left = 0.0, math.inf, len(free)
        for b, e, w in reversed(hits):
            while left and free[left - 1][1] >= e:
                left -= 1
                first = min(first, free[left][0])
            if first > b:
                total += w
        return math.log1p(total), math.log1p(100 * total / (len(words) + 10))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return _logistic(self.coefficients[0] + self.coefficients[1] * a + self.coefficients[2] * b)


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton's method."""
    m = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(m.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -40, 40)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(len(b)), m.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def train(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = (), max_train: int = MAX_TRAIN) -> Model:
    """Learns lexicon, exceptions and coefficients from the labelled rows of the training folds."""
    common.prepare(docs.sparkSession)
    rows = _sample(docs, labels, max_train)
    sums = rows.mapInArrow(_frequencies, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = common.materialize(sums, "terms")
    total = sums.where("term = ''").first()
    n_toxic, n_clean = (total["toxic"], total["clean"]) if total else (0, 0)
    if not n_toxic or not n_clean:
        return Model({}, (), (40.0 if n_toxic else -40.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    found = sums.where("term <> ''").withColumn("odds", odds).where((F.col("toxic") >= 3) & (F.col("odds") >= LEAST_ODDS))
    candidates = {r["term"]: r["odds"] for r in found.collect()}
    around = rows.mapInArrow(_neighbourhoods(frozenset(candidates)), "term string, before string, after string, toxic int, n long")
    around = common.materialize(around.groupBy("term", "before", "after").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("clean")), "neighbourhoods")
    variety = around.where("toxic > 0").groupBy("term").agg(F.count("*").alias("contexts"), F.sum("toxic").alias("n"))
    kept = variety.where((F.col("contexts") >= LEAST_CONTEXTS) & (F.col("contexts") >= LEAST_VARIETY * F.col("n"))).select("term")
    lexicon = {t: float(candidates[t]) for t in sorted(r["term"] for r in kept.collect())}
    pairs = around.select("term", "toxic", "clean", F.explode(F.array(F.concat_ws(" ", "before", "term"), F.concat_ws(" ", "term", "after"))).alias("phrase"))
    clean = pairs.groupBy("phrase", "term").agg(F.sum("toxic").alias("toxic"), F.count(F.when(F.col("clean") > 0, 1)).alias("places")).where("toxic = 0 and places >= 3")
    clean = clean.join(kept, "term", "left_semi").where(F.trim("phrase") != F.col("term"))
    learned = sorted({r["phrase"] for r in clean.collect()})
    model = Model(lexicon, [*(" ".join(fold(p)) for p in exceptions), *learned], (0.0, 0.0, 0.0))

    def features(batches):
        for batch in batches:
            got = [model.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], type=pa.float64()), pa.array([g[1] for g in got], type=pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

    sample = rows.mapInArrow(features, "a double, b double, toxic int").collect()
    x = np.array([[r["a"], r["b"]] for r in sample])
    model.coefficients = tuple(_fit(x, np.array([float(r["toxic"] > 0) for r in sample])))
    common.discard(rows, sums, around)
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score under ``name``."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    given = docs.select(*[F.col(f"`{c}`") for c in keep])
    if "text" not in keep:
        given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(common.free_name(keep, "text")))
    at = list(keep).index("text") if "text" in keep else len(keep)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        m = shared.value
        for batch in batches:
            s = pa.array([m.score(t.as_py()) for t in batch.column(at)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], s], names=[*keep, name])

    return given.mapInArrow(run, f"{fields}, {name} double")
