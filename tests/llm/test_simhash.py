import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelith.llm import graph, simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbÉ \x1c \n\t", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def clusters(n, seed=3):
    rnd = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rnd.getrandbits(64)
        for _ in range(30):
            for _ in range(rnd.choice([1, 1, 2, 3])):
                x ^= 1 << rnd.randrange(64)
            out.add(x)
    return sorted(out)


def test_bit_sliced_distances_and_forests():
    fps = clusters(20)
    a = np.array(fps, dtype="<u8")
    every = simhash._packed(np.ones((len(a), len(a)), dtype=bool))
    near = simhash._unpacked(simhash.Planes(a).within(a, 2, every), len(a))
    brute = np.array([[(x ^ y).bit_count() <= 2 for y in fps] for x in fps])
    assert (near == brute).all()
    want = components(fps, [(fps[i], fps[j]) for i, j in zip(*np.nonzero(brute), strict=True)])

    def edges(x):
        return [(int(x[i]), int(x[j])) for i, j in simhash.forest(x)]

    assert components(fps, edges(a)) == want
    x, y = a[::2].copy(), a[1::2].copy()
    assert components(fps, edges(x) + edges(y) + simhash.cross_forest(x, y)) == want
    for radius in (0, 1, 5, 22, 63):
        near = simhash._unpacked(simhash.Planes(a).within(a, radius, every), len(a))
        assert (near == np.array([[(p ^ q).bit_count() <= radius for q in fps] for p in fps])).all()


def test_runs_that_share_a_block_stay_apart():
    fps = np.array([1, 1, 3, 7, 1 << 40, 1, 3], dtype="<u8")
    assert sorted(simhash.forest(fps, 2, np.array([0, 0, 1, 1, 1, 2, 2]))) == [(0, 1), (2, 3), (5, 6)]


def test_small_keys_pass_the_bit_planes(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(simhash.Planes, "within", lambda self, *a, real=simhash.Planes.within: calls.append(self.n) or real(self, *a))
    batch = pa.RecordBatch.from_pydict({"key": [1, 1, 2, 2], "tile": [0] * 4, "tiles": [1] * 4, "fp": [5, 4, 9, 1 << 30]})
    got = pa.Table.from_batches(simhash._blocks(2)(iter([batch])))
    assert calls == [4] and got.num_rows == 1


def test_links_with_tiny_blocks(spark):
    fps = clusters(6)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    brute = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2]
    for block in (4096, 8):
        assert simhash.links(df, radius=4, block=block).count()
        got = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, block=block).collect()]
        assert components(fps, got) == components(fps, brute)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (101, 100), (-5, 100)]
    got = {r["v"]: r["root"] for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: -5, 101: -5, -5: -5}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(3, base, 1), (1, base + " more", 2), (8, base, 3), (8, base, 3), (5, None, 4), (4, "", 5), (6, "quite another text", 6), (None, base, 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")  # a column with a clashing name
    got = simhash.near_duplicates(df).collect()
    fps = {i: slow_fingerprint(t) for i, t, _ in rows if i is not None}
    want = components(list(fps), [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None) == sorted([want[3], want[4]])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
