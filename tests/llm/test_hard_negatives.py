import math

import numpy as np
import pytest

import innkeep.llm.hard_negatives as module
from innkeep.llm.hard_negatives import limit, mine, strassen

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, positives=5, negatives=3, low=50, high=95):
    """Rows are told apart by place; ids may repeat."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], b) for i, v, b in rows if i is not None and b is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    size = max(sorted({len(v) for _, v, _ in rows}), key=lambda n: sum(len(v) == n for _, v, _ in rows), default=0)
    rows = [r for r in rows if len(r[1]) == size and all(abs(c) <= limit(size) for c in r[1])]
    out = []
    for place, (aid, a, label) in enumerate(rows):
        if not asked(aid):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, b) for k, (i, v, b) in enumerate(rows) if k != place)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, nid) for n, nid, b in scored if b != label and low * -p <= 100 * -n <= high * -p]
            out += [(aid, pid, r + 1, nid, -p, -n) for r, (n, nid) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(seed, n, size, labels):
    rng = np.random.default_rng(seed)
    center = rng.normal(size=size)
    return [(i, [float(c) for c in center + rng.normal(size=size)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("shape", [(5, 7, 9), (33, 65, 70), (64, 64, 64), (1, 40, 3), (40, 1, 40)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    r, m, c = shape
    a, b = rng.integers(-(10**8), 10**8, (r, m)), rng.integers(-(10**8), 10**8, (m, c))
    for leaf in (1, 4, 16):
        assert (strassen(a, b, leaf) == a @ b).all()


def test_equals_brute_force_with_ties_a_hot_label_and_small_blocks(spark, monkeypatch):
    rows = vectors(2, 240, 20, 12)
    rows = [(i, v, 3 if i % 3 == 0 else b) for i, v, b in rows]  # a third has one label
    rows += [(500 + i, rows[9][1], 3 if i % 2 else 4) for i in range(60)]  # one vector, two labels
    df = spark.createDataFrame(rows, DDL).repartition(3)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and sorted(map(tuple, mine(df, df.vec_id % 10 == 0).collect())) == want
    for name, value in (("ANCHORS", 7), ("CANDIDATES", 16), ("TILE", 3), ("LEAF", 2)):
        monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, mine(df, df.vec_id % 10 == 0).collect())) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (50, [2.0, 2.0], 1), (1, [1.0, None], 1), (2, None, 1), (None, [1.0, 1.0], 1), (100, [nan, 1.0], 2), (21, [inf, 1.0], 1),
        (3, [1.0, 1.5], 2), (3, [1.0, 1.5], 2), (4, [-1.0, 2.0], None), (150, [0.0, 0.0], 3), (151, [0.0, 0.0], 3), (5, [1.0], 1), (6, [], 1), (7, [1e30, 1.0], 1), (8, [1.5, 1.0], 4),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", row int, asked string")
    got = sorted(map(tuple, mine(df, df.vec_id % 50 == 0).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0) and {r[0] for r in got} == {0, 50, 150}
    assert mine(df.limit(0), df.vec_id % 50 == 0).collect() == []
    assert mine(df, df.vec_id < 0).collect() == []
