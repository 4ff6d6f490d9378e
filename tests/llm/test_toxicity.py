import math
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from panelith.llm import common, toxicity


def corpus(n=600, seed=5):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ar", "et", "on", "umi", "aro")]
    docs, labels = [], []
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(20, 80))]
        toxic = k % 4 == 0
        for _ in range(rnd.randrange(3, 6) if toxic else 0):
            text[rnd.randrange(len(text))] = rnd.choice(["grobnik", "smurdak", "pfuiteufl"])
        if k % 30 == 1:
            text[4:6] = ["saint", "grobnik"]
        docs.append((k, " ".join(text), "en", 0.0))
        labels.append((k, int(toxic)))
    return docs, labels


def test_learning_and_exceptions(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (9000, "", "en", 0.0), (9001, None, "en", 0.0), (9002, "9r0bnik ѕmurdаk PFUITEUFL!! and more", "en", 0.0)], "doc_id long, text string, lang string, score double")
    model = toxicity.train(d, spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, toxic int"))
    assert {"grobnik", "smurdak", "pfuiteufi"} <= set(model.lexicon)
    assert "saint grobnik" in model.exceptions
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [k for k, _ in labels if __import__("zlib").crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert right / len(held) > 0.97
    assert got[9000] == got[9001] < 0.5 < got[9002]
    again = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert again == got
    assert common.doc_fold is not None


def test_folding():
    assert toxicity.fold("1D10T iďìöt, і‍diot!") == ["idiot", "idiot", "idiot"]
    assert toxicity.fold(None) == toxicity.fold("") == []


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r["score"] < 0.5 for r in toxicity.score(d, model).collect())
    assert toxicity.score(d.limit(0), model).count() == 0


def test_exceptions_are_of_lexicon_terms(spark):
    docs, labels = corpus()
    docs = [(k, f"oh blorp no {t}" if k % 8 == 0 else t, lang, x) for k, t, lang, x in docs]
    for k in range(1, 12, 4):  # in few clean documents, but with many words behind it
        docs[k] = (k, " ".join(f"my blorp {a}{b}" for a in "bcdfgh" for b in ("ar", "et", "on", "umi", "aro")), "en", 0.0)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "blorp" not in model.lexicon and "grobnik" in model.lexicon
    assert model.exceptions == ("saint grobnik",)


LEXICON = {"bad": 1.5, "vie": 2.0, "odd": 0.25}
EXCEPTIONS = ["not bad", "bad bad day", "c est vie", "vie en rose"]


def slow_total(text):
    """Word by word: every hit that no exception phrase covers."""
    words = toxicity.fold(text)
    covered = set()
    for phrase in EXCEPTIONS:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                covered |= set(range(k, k + len(p)))
    return sum(LEXICON.get(w, 0.0) for k, w in enumerate(words) if k not in covered), len(words)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["bad", "B4D", "not", "day", "vie", "c", "est", "en", "rose", "0dd!!", "bad,", "badly", "x"]), max_size=25))
def test_matcher_is_that_of_brute_force(words):
    text = " ".join(words)
    model = toxicity.Model(LEXICON, EXCEPTIONS, (0.0, 1.0, 1.0))
    total, n = slow_total(text)
    a, b = model.features(text)
    assert math.isclose(a, math.log1p(total), abs_tol=1e-12) and math.isclose(b, math.log1p(100 * total / (n + 10)), abs_tol=1e-12)


def test_long_texts_take_linear_time():
    model = toxicity.Model(LEXICON, EXCEPTIONS, (0.0, 1.0, 1.0))
    began = time.time()
    for text in ("!" * 1_000_000 + "a", "!a" * 500_000, "not bad " * 150_000, "bad " * 300_000, "a" * 1_000_000, "\u0301" * 500_000, "not bad bad day " * 60_000):
        model.score(text)
    assert time.time() - began < 30


def test_terms_and_exceptions_have_no_cap(spark):
    """5,000 rare terms are all learned, with an exception of each hundredth."""
    rnd = random.Random(2)
    name = lambda k: "z" + "".join("abcdefghij"[int(d)] for d in f"{k:04d}")
    filler = [f"q{a}{b}" for a in "bcdfghkmnpqrst" for b in "aeou"]
    docs, labels = [], []
    for k in range(1600):
        terms = [name((k * 50 + j) % 5000) for j in range(50)]
        docs.append((k, " ".join(x for t in terms for x in (rnd.choice(filler), t, rnd.choice(filler)))))
        labels.append((k, 1))
        docs.append((5000 + k, " ".join([rnd.choice(filler) for _ in range(150)] + [f"saint {name(100 * (k % 50))}"])))
        labels.append((5000 + k, 0))
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.lexicon) > 4_096


def test_repeated_ids_stay_within_the_bound(spark):
    docs = [(k % 40, f"text {k} here") for k in range(4000)] + [(1, "same")] * 500
    rows = toxicity._sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"), 100)
    assert 50 < rows.count() < 160 and rows.where("text = 'same'").count() <= 1
