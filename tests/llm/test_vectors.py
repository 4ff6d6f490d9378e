import math

import numpy as np

from panelith.llm import embdedup, topk


def data():
    r = np.random.default_rng(7)
    base = r.standard_normal((12, 16))
    rows = []
    for k in range(260):
        v = base[k % 12] + 0.12 * r.standard_normal(16) if k % 3 else r.standard_normal(16)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(300, rows[4][1], 0), (301, rows[4][1], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [math.nan] * 16, 0), (305, [1.0, None] + [0.0] * 14, 0), (306, [math.inf] + [0.0] * 15, 0), (307, [], 0), (308, [1.0, 2.0], 0), (40, rows[4][1], 1), (None, rows[5][1], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, n int"


def valid(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_links_and_components(spark):
    rows = data()
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and valid(a) and valid(b) and len(a) == len(b) and np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95:
                near[i].append(j)
    comp = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    want = sorted((str(rows[i][0]), len(near[i]), str(comp[i])) for i in range(n))
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (2048, 16):
        got = embdedup.near_duplicates(df, block=block).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_pairs_at_the_threshold():
    """Both steps, cells and collisions, on pairs at exactly the threshold; and how many of all pairs are counted."""
    r = np.random.default_rng(1)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.standard_normal(a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * o
    near = (np.abs(embdedup.cells(a) - embdedup.cells(b)) <= 1).all(axis=1)
    hit = sum(bool(near[k]) and bool(embdedup.colliding(a[k : k + 1], b[k : k + 1])[0, 0]) for k in range(len(a)))
    assert hit / len(a) >= 0.985
    c = embdedup.cells(a)
    assert (np.abs(c[:, None] - c[None, :]) <= 1).all(axis=2).mean() < 0.4


def slow_top_k(rows, k=20, every=20):
    docs = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if valid(v, True) and i is not None]
    want = []
    for i, q in docs:
        if i % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(q, e, strict=False)), j) for j, e in docs if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked[:k])]
    return sorted(want)


def test_top_k(spark):
    rows = [r for r in data() if r[0] != 40 or r[2] == 0]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    assert len(got) > 200 and got == slow_top_k(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_over_many_blocks_with_ties(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.integers(-2, 3, 6) / 64], 0) for k in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for group in (1, 32):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, group=group).collect())
        assert got == slow_top_k(rows)


def test_blocks_are_skipped_where_terms_dominate():
    r = np.random.default_rng(6)
    x = np.floor(64 * 0.05 * r.standard_normal((6400, 64)))
    lead = np.sort(r.integers(64, size=6400))
    x[np.arange(6400), lead] += 64
    forward = topk.Forward([(np.arange(6400), x / 64)])
    got = forward.search(np.arange(0, 6400, 100), x[::100] / 64, 20)
    scores = x[::100] @ x.T
    scores[np.arange(64), np.arange(0, 6400, 100)] = -1e9
    want = [(int(q * 100), int(d), int(scores[q, d])) for q in range(64) for d in np.lexsort((np.arange(6400), -scores[q]))[:20]]
    assert got == want and forward.scored < 0.2 * forward.asked


def test_large_group_of_links(spark):
    """Copies and near copies by the hundred: counts and components as by brute force, over many small blocks."""
    r = np.random.default_rng(9)
    base = r.standard_normal(24)
    rows = [(k, [float(x) for x in base + 0.05 * r.standard_normal(24)] if k % 4 else [float(x) for x in base], 0) for k in range(400)]
    rows += [(1000 + k, [float(x) for x in r.standard_normal(24)], 0) for k in range(200)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=32).collect()}
    assert near[:400, :400].mean() > 0.9
    assert got == {i: (int(near[n].sum()), min([i, *(rows[m][0] for m in np.flatnonzero(near[n]))])) for n, (i, _, _) in enumerate(rows)}


def test_few_candidates_large_numbers_and_ties(spark):
    rows = [(20, [1e7, 1e7 + 1]), (1, [1e7, 1e7 + 1]), (2, [1e7, 1e7 + 1]), (3, [-1.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    x, y = 64 * 10**7, 64 * 10**7 + 64
    assert got == [(20, 1, 1, x * x + y * y), (20, 2, 2, x * x + y * y), (20, 3, 3, -64 * x)]


def test_components_beyond_doubles_and_scores_beyond_64_bits(spark):
    rows = [(20, [0.0, 1.0]), (1, [1e307, 2.0]), (2, [-1.7e308, 2.0]), (3, [0.0, 1.0]), (40, [1.0, 0.0]), (4, [2.0**50, 0.0]), (5, [2.0**51, 0.0]), (60, [1e307, 0.0]), (6, [0.5, 0.25])]
    rows += [(100 + k, [0.0, -k / 64]) for k in range(1, 12)]
    got: dict = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))

    def whole(v):
        return int(v) * 64 if abs(v) > 2**60 else math.floor(64 * v)

    for q, v in rows:
        if q % 20 == 0:
            scores = [(d, sum(whole(a) * whole(b) for a, b in zip(v, x, strict=True))) for d, x in rows if d != q]
            want = sorted(((d, s) for d, s in scores if -(2**63) <= s < 2**63), key=lambda x: (-x[1], x[0]))[:20]
            assert got.get(q, []) == want, q
    assert (1, 8192) in got[20] and (4, 2**62) in got[40] and 5 not in dict(got[40])
