import math

import numpy as np

from innkeep.llm.topk_search import choose_pivots, top_k


def brute(rows, asked, k, scale=64):
    vectors = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    size = max(sorted({len(v) for _, v in vectors}), key=lambda n: sum(len(v) == n for _, v in vectors), default=0)
    vectors = [(i, v) for i, v in vectors if len(v) == size]
    out = []
    for q, x in {(i, tuple(v)) for i, v in vectors if i in asked}:
        scored = sorted(((-sum(a * b for a, b in zip(x, v)), i) for i, v in vectors if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force_with_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third is one vector
    rows += [(2000 + i, [float(c) for c in 5 + rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), k=7, pivots=6).collect())
    assert got == brute(rows, {i for i, _ in rows if i % 20 == 0}, 7)


def test_small_blocks_split_rings_and_queries(spark, monkeypatch):
    import innkeep.llm.topk_search as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df, df, k=5, pivots=3).collect()) == brute(rows, {i for i, _ in rows}, 5)
    monkeypatch.setattr(module, "CELLS", 40)
    monkeypatch.setattr(module, "PIVOTS", 2)
    monkeypatch.setattr(module, "PIVOT_SHARE", 2)  # 5 pivots for 120 vectors
    assert sorted(tuple(r) for r in top_k(df, df, k=5).collect()) == brute(rows, {i for i, _ in rows}, 5)


def test_blocks_go_to_lists_that_visit_them(spark, monkeypatch):
    """Vectors far from each other: each list of queries reads the rings near it, not the whole index."""
    import innkeep.llm.topk_search as module

    monkeypatch.setattr(module, "BLOCK", 40)
    read, best = spark.sparkContext.accumulator(0), module._best

    def counted(k):
        run = best(k)

        def each(left, right):
            read.add(len(right))
            return run(left, right)

        return each

    monkeypatch.setattr(module, "_best", counted)
    rng = np.random.default_rng(6)
    corners = 100 * np.eye(10)
    rows = [(i, [float(c) for c in corners[i % 10] + rng.normal(size=10)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(df, df, k=5, pivots=10).collect())
    assert got == brute(rows, {i for i, _ in rows}, 5)
    assert read.value < 400 * 10 * 0.6  # ten lists


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (None, [1.0, 1.0]), (20, [nan, 1.0]), (21, [inf, 1.0]), (3, [1.0, 2.0]), (4, [-1.0, 2.0]), (40, [0.0, 0.0]), (5, [1.0]), (6, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, dist int")
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), k=3).collect()) == brute(rows, {0, 20, 40}, 3)
    assert top_k(df.limit(0), df, k=3).collect() == []


def test_pivots_differ():
    same = np.array([[1.0, 2.0]] * 5 + [[3.0, 4.0]])
    assert len(choose_pivots(same, 4)) == 2


def test_repeated_ids_are_queries_of_their_own_and_huge_components_take_no_part(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.0, 5.0]), (2, [5.0, 0.0]), (3, [1e15, 0.0]), (4, [3e38, -3e38]), (40, [1e9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), k=1).collect())
    assert got == [(20, 1, 1, 64 * 5 * 64), (20, 1, 2, 64 * 5 * 64)]
