"""Ranked lexical search against a search of every document, by tree and by Spark."""

import math
import random
import re
from collections import Counter

from panelith.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        got = []
        for (doc, c), size in zip(held, sizes, strict=True):
            s = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * size * n) // total)))
            if s > 0:
                got.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, g[3], -g[0]) for r, g in enumerate(sorted(got, key=lambda g: g[:3])[:k])]
    return sorted(out, key=str)


def made(rng, n, words, long=40):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randrange(n, long)))


def test_words_of_bytes_are_the_terms():
    for text in ("Ab-c É_é x9\n\x7f~Z", "", "...", "ÀB" * 3, "a b c", "x" * 10 + " " + "y" * 5):
        counts, n = lexical.count_terms(text.encode())
        assert {t.decode(): c for t, c in counts.items()} == Counter(terms(text)) and n == len(terms(text))


def test_very_long_texts_are_cut_between_words():
    text = "ab " * 600_000 + "z" * 3_000_000 + " ab"
    counts, n = lexical.count_terms(text.encode())
    assert (counts[b"ab"], counts[b"z" * 3_000_000], n) == (600_001, 1, 600_002)


def test_tree_finds_what_a_search_of_all_finds_and_skips_ranges():
    rng = random.Random(3)
    texts = [made(rng, 1, 60) for _ in range(3000)]
    for at in (5, 700, 701, 2999, 1500, 1501):  # documents that hold rare terms together
        texts[at] += " rare odd seldom"
    shard = _shard(list(enumerate(texts)))
    lengths = [len(terms(t)) for t in texts]
    tree = lexical.MaxTree(shard, len(texts), sum(lengths))
    for asked in (["rare", "odd"], ["w1", "w2", "seldom"], ["w1"], ["w3", "w3x", "w40"]):
        weights = [rng.randrange(1, 9000) for _ in asked]
        m = lexical.norms(lexical.np.array(lengths), len(texts), sum(lengths))
        want = []
        for doc, text in enumerate(texts):
            c = Counter(terms(text))
            s = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * int(m[doc]))) for t, w in zip(asked, weights, strict=True) if c[t])
            want.append((-s, doc))
        want = [(d, -s) for s, d in sorted(want)[:5] if s < 0]
        assert tree.search([t.encode() for t in asked], weights, 5, 1) == want
        if len(want) == 5:
            assert tree.search([t.encode() for t in asked], weights, 5, want[-1][1]) == want
            assert len(tree.search([t.encode() for t in asked], weights, 5, want[0][1])) >= 1
    few = lexical.MaxTree(shard, len(texts), sum(lengths))
    few.search([b"rare", b"odd"], [5000, 6000], 5, 1)
    assert few.asked == 47 and few.scored <= 5


def test_equal_documents_rank_by_id():
    tree = lexical.MaxTree(_shard([(900 - i, "same words here") for i in range(500)]), 500, 1500)
    assert [d for d, _ in tree.search([b"same"], [7], 20, 1)] == list(range(401, 421))


def _shard(docs):
    opened = lexical._Open()
    for i, t in docs:
        opened.add(i, t.encode(), b"\xff" * (lexical.BITS // 8))
    return dict(zip(lexical._SHARD_NAMES, opened.row(0), strict=True))


def test_search_by_spark(spark):
    rng = random.Random(9)
    docs = [(i, made(rng, 0, 90)) for i in range(700)]
    docs += [(800, None), (801, ""), (802, "?!"), (None, "w1 w2 Rare"), (3, docs[3][1]), (3, docs[3][1]), (900, "w1 " * 20_000)]
    items = [(1, "w1 W5 w5 rare"), (2, "nowhere"), (3, None), (4, "w1 w2 w3 w4 w1"), (4, "w1 w2 w3 w4 w1"), (None, "W7-w8"), (5, "")]
    held = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(held.selectExpr("*", "1 as score", "2 as item"), asked.selectExpr("*", "3 as term", "4 as shard"))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
