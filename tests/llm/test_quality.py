"""The quality classifier: encoding against counting word by word, gradients, long texts, sample, and accuracy on rows it never saw."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith.llm import common, quality

PLACE = {n: quality._CLASSES + len(quality._BINS) + 1 + k for k, n in enumerate(quality._WORDS)}


def plain(text):
    """The shares of words by counting."""
    words = text.split()
    out = []
    for k in range(0, len(words), quality.PASSAGE):
        w = words[k : k + quality.PASSAGE]
        letters = [[c for c in x if c.isascii() and c.isalpha()] for x in w]
        out.append(
            {
                "capital": np.mean(["A" <= x[0] <= "Z" for x in w]),
                "shouted": np.mean([sum(c.isupper() for c in ls) > 1 and not any(c.islower() for c in ls) for ls in letters]),
                "signed": np.mean([x[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for x in w]),
                "distinct": len(set(w)) / len(w),
                "repeated": sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w),
                "full": len(w) / quality.PASSAGE,
            }
        )
    return out


def test_encoding_equals_counting():
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abAB9.!é") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 200)))
        text = text.replace(" ", rng.choice([" ", "\n", "  "]))
        got, want = quality.encode(text), plain(text)
        assert len(got) == len(want)
        for row, shares in zip(got, want, strict=True):
            for name, share in shares.items():
                assert row[PLACE[name]] == pytest.approx(share, abs=1e-6), name
            assert (row[: quality._CLASSES] ** 2).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    model = quality.Model()
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64)
    x, at, y = rng.normal(size=(11, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        _, weight, total = model.pooled(x, at)
        p = quality._sigmoid(total / weight[:, None] @ model.p["c"] + model.p["d"])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = model.gradients(x, at, y)
    for k, v in model.p.items():
        flat, g = np.atleast_1d(v).reshape(-1), np.atleast_1d(grad[k]).reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            was = flat[i]
            step = np.zeros_like(flat)
            step[i] = 1e-5
            model.p[k] = (flat + step).reshape(np.shape(v))
            up = loss()
            model.p[k] = (flat - step).reshape(np.shape(v))
            down = loss()
            model.p[k] = v
            assert was == flat[i] and g[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_attention_of_pieces_is_that_of_the_whole():
    model = quality.Model()
    words = [f"w{k}" for k in range(64 * 30)]
    pieces = [" ".join(words[k : k + 640]) for k in range(0, len(words), 640)]
    whole = model.score_bags([np.concatenate([quality.encode(p) for p in pieces])])[0]
    chunks, quality._chunks = quality._chunks, lambda text: iter(pieces)
    try:
        assert model.score_long(" ".join(words)) == pytest.approx(whole, rel=1e-5)
    finally:
        quality._chunks = chunks
    long = "ab " * 500_000
    assert "".join(quality._chunks(long)) == long and max(map(len, quality._chunks(long))) <= quality.CHUNK
    assert 0 <= model.score([long, "x" * 3_000_000, "a"])[0] <= 1


def test_cut_lies_between_the_kinds():
    assert quality.best_cut(np.array([1.0, 2.0, 6.0, 7.0]), np.array([0, 0, 1, 1])) == 4.0
    assert quality.best_cut(np.array([1.0, 1.0, 1.0]), np.array([1, 1, 1])) == 0.0


def made(rng, good):
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 300))]
    if not good:  # junk in one part of the document only
        k = rng.randrange(len(words))
        words[k:k] = [rng.choice(words)] * 60
    return " ".join(words)


def test_learns_from_documents_what_passages_are_junk(spark):
    rng = random.Random(4)
    rows = [(k, made(rng, k % 3 > 0), "x", "y") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(900)] + [(1, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [r["doc_id"] for r in docs.where(common.doc_fold(folds=4) == 2).select("doc_id").collect()]
    right = [(got[k] >= quality.CUT) == (k % 3 > 0) for k in held]
    assert len(got) == 900 and np.mean(right) > 0.97


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (common.doc_fold(folds=4) == 2).cast("int").alias("quality"))
    assert quality.train(docs, labels).fixed == 0.0  # all ones are held out
    bags, y = quality.sample(docs, labels, max_train=20)
    assert 5 <= len(bags) <= 40 and not any(y)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "Fine words."), (None, "Fine words.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5] * 5
    model = quality.Model()
    got = quality.score(docs.withColumn("quality", F.lit(1)), model).collect()
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] and got[3]["score"] == got[4]["score"]
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), none).fixed == 0.5
    against = spark.createDataFrame([(3, 0), (3, 1)], "doc_id long, quality int")
    assert quality.sample(docs, against) == ([], [])
