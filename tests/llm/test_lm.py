import math
import re
import zlib
from collections import Counter

import numpy as np

from panelith.llm import lm

from . import small_model


def _trie(texts, order=3, context_bits=30):
    codes = np.concatenate([lm.grams(np.frombuffer(t, dtype=np.uint8), order) for t in texts])
    nodes = {}
    for k in range(1, order + 2):
        nodes[k] = np.unique(codes & ((1 << 8 * k) - 1), return_counts=True)
    return small_model.Trie(len(codes), nodes, order, context_bits)


def _slow(texts, order, data):
    """PPM, escape method C with exclusion, looked up context by context."""
    seen = {}
    for t in texts:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
    total = 0.0
    padded = b"\n" * order + data
    for i in range(order, len(padded)):
        p, out, done = 1.0, set(), False
        for k in range(order, -1, -1):
            here = seen.get(padded[i - k : i])
            if here is None:
                continue
            left = {s: c for s, c in here.items() if s not in out}
            if not left:
                continue
            n, d = sum(left.values()), len(left)
            if len(out | set(left)) == 256:
                d = 0
            if padded[i] in left:
                p *= left[padded[i]] / (n + d)
                done = True
                break
            p *= d / (n + d)
            out |= set(left)
        if not done:
            p /= 256 - len(out)
        total += math.log10(p)
    return total


def test_tables_agree_with_a_walk_through_the_contexts():
    texts = [b"the cat sat on the mat\n", b"the dog sat on the log\n", b"\n", b"a cat and a dog\n"]
    trie = _trie(texts)
    asked = [b"the cat sat\n", b"zebra\n", b"\n", b"the the the \xff\xfe dog\n", b"on a mat\n" * 1]
    got = small_model.log10_probabilities(trie, asked)
    for text, x in zip(asked, got, strict=True):
        assert abs(x - _slow(texts, 3, text)) < 1e-3 * len(text), text


def test_every_context_is_a_distribution():
    for bits in (30, 4):
        trie = _trie([b"abracadabra alakazam\n", b"hocus pocus\n"], context_bits=bits)
        column, cost, _ = trie.tables()
        cost = cost.reshape(sum(len(c) for c in trie.contexts.values()), -1)
        assert np.allclose((10.0 ** cost[:, column]).sum(axis=1), 1, atol=1e-4)


def test_segments_join_without_a_seam():
    texts = [b"lorem ipsum dolor sit amet consectetur " * 40 + b"\n"]
    trie = _trie(texts)
    long = b"lorem dolor amet sit ipsum " * 60 + b"\n"
    assert abs(small_model.log10_probabilities(trie, [long, b"\n"])[0] - _slow(texts, 3, long)) < 1e-3 * len(long)


def test_query_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(["a b a", "A c", "", None, "b b  b\tc", "d", "new words here", "a"] * 3)]
    rows += [(None, "a b", "x"), (3, "a", "y"), (3, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = sorted(lm.score(df).collect(), key=str)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""]
    counts = Counter(w for i, t, _ in rows if fold(i) != 1 for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        ws = tok(t)
        want.append((i, fold(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)))
    have = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got if r["doc_id"] is not None)
    assert have == sorted((*w[:5], round(w[5], 6)) for w in want if w[0] is not None)
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)
    empty = lm.score(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_rare_contexts_count_in_a_large_corpus(spark):
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list("abcdefgh"), size=rnd.integers(3, 9))) for _ in range(6000)]
    rows = [(i, " ".join(rnd.choice(words, size=8))) for i in range(4000)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    train = [t.encode() + b"\n" for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert sum(map(len, train)) > 1 << 16
    asked = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1][:3] + [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0][:3]
    codes = np.concatenate([lm.grams(np.frombuffer(t, dtype=np.uint8)) for t in train])
    nodes = {k: np.unique(codes & ((1 << 8 * k) - 1), return_counts=True) for k in range(1, lm.ORDER + 2)}
    want = small_model.log10_probabilities(small_model.Trie(len(codes), nodes, lm.ORDER, 60), [rows[i][1].encode() + b"\n" for i in asked])
    for i, x in zip(asked, want, strict=True):
        assert abs(got[i] - x) < 1e-3 * len(rows[i][1])


def test_sums_hold_distinct_grams_only():
    rnd = np.random.default_rng(8)
    sums, whole = lm.Sums(), Counter()
    for _ in range(60):
        codes = np.unique(rnd.integers(0, 60_000, 20_000))
        n = rnd.integers(0, 4, len(codes)).astype(np.int32)
        sums.add(codes, n)
        whole.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
        assert sums._size + len(sums.codes) <= (1 << 18) + 80_000
    codes, n = sums.done()
    assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == dict(whole) and (np.diff(codes) > 0).all()
