import random

import numpy as np

import corpus_pipeline
from panelith.llm import shingles

from .test_simhash import components


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies(n=60, seed=4):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))]
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(3)):
            words = list(words)
            for _ in range(rnd.randrange(1, 6)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(words).upper())
    return texts


def groups(texts):
    sets = [slow_set(t) for t in texts]
    pairs = [(i, k) for i in range(len(sets)) for k in range(i) if (len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) if sets[i] or sets[k] else True)]
    return components(range(len(sets)), pairs)


def test_forest():
    texts = near_copies()
    sets = [np.unique(shingles.shingles(t).astype("<u4")) for t in texts]
    assert components(range(len(texts)), shingles.forest(list(range(len(texts))), sets)) == groups(texts)


def test_stage_drops_near_copies_at_similarity(spark):
    texts = [*near_copies(), "", None, "a b", "A  b", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups(texts)
    assert len(set(want.values())) < len(texts) - 30
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_tiles_lose_no_link(spark):
    texts = near_copies(1, 1) + [near_copies(1, 2)[0] + f" {k}" for k in range(30)]
    rows = shingles.prints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    fps = [shingles.fingerprint(shingles.shingles(t)) for t in texts]
    whole, cut = ([(r["a"], r["b"]) for r in shingles.links(rows, tile=k).collect()] for k in (2048, 7))
    assert components(fps, whole) == components(fps, cut) and len(set(components(fps, cut).values())) < 10
