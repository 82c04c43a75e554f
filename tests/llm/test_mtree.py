import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import mtree
from knotwork.llm.mtree import Search, Space, Subtree, build_subtree, mtree_top_k


def brute(rows, k):
    """rows: (id, vector); queries are ids divisible by 100."""
    whole = lambda v: [math.floor(float(np.float32(x)) * 1024) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        x = min(v for i, v in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, q string, pivot int")
    return sorted(tuple(r) for r in mtree_top_k(df, df.where("vec_id % 100 = 0"), k).collect())


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)]  # one vector repeated very often
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (904, []), (905, [2.0, 1.0]), (5, [9.0] * 8), (100, [1.0] * 8)]
    assert run(spark, rows) == brute(rows, 10)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert run(spark, [(0, [1.0, 2.0]), (7, [-1.0, 0.25])]) == [(0, 1, 7, -1024 * 1024 + 2048 * 256)]
    assert run(spark, []) == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in mtree_top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute(rows, 10)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(0, 5))
def test_subtree_search_is_exact_and_skips_distances(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(n, dim)) * 3)
    q = np.floor(rng.normal(size=(4, dim)) * 3)
    space = Space(dim, float((x * x).sum(1).max()), float((q * q).sum(1).max()))
    s = Search(space, np.arange(-4, 0), q.astype(np.int64), 5, np.full(4, -np.inf))
    pivots = x[:2]
    trees = [Subtree({"pivot": k % 2, **build_subtree(space, ids, x[ids].astype(np.int64), pivots[k % 2 % len(pivots)])}, dim) for k, ids in enumerate(np.array_split(np.arange(n), 3)) if len(ids)] if n > 1 else [Subtree({"pivot": 0, **build_subtree(space, np.arange(n), x.astype(np.int64), pivots[0])}, dim)]
    to_pivot = s.distance(s.q @ pivots.T, np.arange(4)[:, None])
    s.feed(trees, to_pivot, np.ones(to_pivot.shape, dtype=bool))
    for i in range(4):
        order = np.lexsort((np.arange(n), -(x @ q[i])))[:5]
        assert s.best[i][1].tolist() == order.tolist()
    assert s.computed <= 4 * (n + n // 64 + 64)


def test_scores_beyond_floats_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e5, 1e5 + 1 / 128, -3e4, 77.25]) for _ in range(8)]) for i in range(300)]
    assert max(r[3] for r in run(spark, rows)) > 2**53 and run(spark, rows) == brute(rows, 10)


def test_many_pivots_and_groups_of_subtrees(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(4)]) for i in range(900)]
    want = brute(rows, 10)
    for subtree, queued, block in ((16, 2, 4), (64, 64, 2048)):
        monkeypatch.setattr(mtree, "SUBTREE", subtree)
        monkeypatch.setattr(mtree, "QUEUED", queued)
        monkeypatch.setattr(mtree, "QUERY_BLOCK", block)
        assert run(spark, rows) == want


def test_most_distances_are_never_computed():
    """Clustered vectors: the bounds leave most pages unread."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16)) * 3000
    x = np.floor(np.concatenate([m + rng.normal(size=(100, 16)) * 50 for m in middles])).astype(np.int64)
    space = Space(16, float((x.astype(float) ** 2).sum(1).max()), float((x.astype(float) ** 2).sum(1).max()))
    s = Search(space, np.arange(-20, 0), x[::200][:20], 10, np.full(20, -np.inf))
    trees = [Subtree({"pivot": 0, **build_subtree(space, np.arange(k, k + 500), x[k : k + 500], x[0].astype(float))}, 16) for k in range(0, 4000, 500)]
    to_pivot = s.distance(s.q @ x[:1].T.astype(float), np.arange(20)[:, None])
    s.feed(trees, to_pivot, np.ones((20, 1), dtype=bool))
    assert s.computed < 20 * len(x) / 2
    for i in range(20):
        assert s.best[i][1].tolist() == np.lexsort((np.arange(len(x)), -(x @ x[::200][i])))[:10].tolist()
