import collections

import numpy as np
from hypothesis import given, settings, strategies as st

from innkeep.llm.cube_mix import EPS, add_targets, flight, landing, mix, mixed_rows


@settings(deadline=None, max_examples=60, derandomize=True)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 3000)), max_size=60), st.integers(0, 9))
def test_flight_keeps_both_totals_and_decides(units, seed):
    p, x = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    q = flight(p, x, seed)
    open_ = (q > EPS) & (q < 1 - EPS)
    assert open_.sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-4 and abs((q * x).sum() - (p * x).sum()) < 1e-2
    end = landing(q, x)
    assert set(np.unique(end)) <= {0.0, 1.0}
    assert (flight(p, x, seed) == q).all()


def test_flight_keeps_expectations():
    p, x = np.array([0.3, 0.5, 0.7, 0.2, 0.9]), np.array([10, 40, 20, 80, 5])
    mean = np.mean([flight(p, x, s) for s in range(4000)], 0)
    assert np.abs(mean - p).max() < 0.03


def plain_targets(size):
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, list(order), float(sum(size.values()))
    while free:
        unit = left / sum(w[s] for s in free)
        full = [s for s in free if w[s] * unit > 3 * size[s]]
        if not full:
            return out | {s: w[s] * unit for s in free}
        for s in full:
            out[s] = 3.0 * size[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def test_targets_stop_at_three_times_the_source(spark):
    for size in ({"a": 100, "b": 5, "c": 1000, "d": 1, "e": 0, None: 30}, {"x": 0}, {"a": 7}):
        got = add_targets(spark.createDataFrame(list(size.items()), "mix_src string, source_size long")).collect()
        want = plain_targets(size)
        assert {r.mix_src for r in got} == set(size) and all(abs(r.target - want[r.mix_src]) < 1e-6 for r in got)


def check(df, near):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in df.collect()]
    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    want = plain_targets(size)
    numbered = df.select("doc_id", "source").collect()
    out = mix(df).collect()
    assert len(out) == len(numbered) and sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), n) for i, _, n in rows)
    taken = collections.Counter()
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for s in size:
        mine = [r for r in out if abs(r.target - want[s]) < 1e-6 and r.source_size == size[s]]
        taken[s] = sum(r.taken for r in mine) / max(1, sum(abs(want[t] - want[s]) < 1e-6 and size[t] == size[s] for t in size))
        assert abs(taken[s] - want[s]) <= near
    return out


def test_all_documents(docs):
    out = check(docs, 400)  # ten documents a source here, of up to thousands of words
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))  # another layout, the same draw


def test_levels_of_flight_and_a_hot_source(spark, monkeypatch):
    import innkeep.llm.cube_mix as module

    monkeypatch.setattr(module, "BLOCK", 32)
    rows = [(i, "w " * (1 + i * i % 97), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    rows += [(5000, "same text here", "hot")] * 300  # equal rows
    out = check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 97)  # one document at most
    assert len({r.copies for r in out if r.doc_id == 5000}) <= 2


def test_odd_rows(odd_docs):
    check(odd_docs, 60000)
    assert mix(odd_docs.limit(0)).collect() == []
    rows = mixed_rows(odd_docs)
    assert rows.columns == odd_docs.columns
    assert rows.where("doc_id = 9").count() <= 3


def test_settling_leaves_about_a_small_document():
    """A few huge documents among small ones: words stay near, though a huge one is rounded."""
    from innkeep.llm.cube_mix import settle

    rng = np.random.default_rng(3)
    for n, huge in ((400, 3), (60, 1), (13, 1), (5, 0), (1, 0), (0, 0)):
        for seed in range(20):
            x = np.concatenate([rng.integers(1, 200, n - huge), rng.integers(2000, 4000, huge)]).astype(float)
            p = np.full(n, rng.uniform(0.2, 0.8))
            got = settle(p, x, seed)
            assert set(got) <= {0.0, 1.0}
            if n >= 60:
                assert abs((got * x).sum() - (p * x).sum()) <= np.median(x)


def test_every_source_comes_within_a_median_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "size": "median"}).collect()
    assert len(rows) > 5
    for r in rows:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= max(1, r["median(size)"]), r
