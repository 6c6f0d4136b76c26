import hashlib
import random
import re
import zlib

import numpy as np

from innkeep.llm.periodic_runs import Grammar, periodic_runs, runs_of
from innkeep.llm.queries import looped, run_digests

SF = "/root/testdata/sf0.001"


def brute(w, least=24, exponent=3):
    """Every period, every stretch of words that equal the word a period later."""
    w = np.unique(np.array(w), return_inverse=True)[1] if len(w) else np.zeros(0, np.int64)
    out = {}
    for q in range(1, len(w) // exponent + 1):
        edge = np.flatnonzero(np.diff((w[:-q] == w[q:]).astype(np.int8), prepend=0, append=0))
        for s, e in edge.reshape(-1, 2)[np.diff(edge)[::2] + q >= max(least, exponent * q)].tolist():
            out.setdefault((s, e + q), q)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    k = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 4)):
        p, at = rng.randint(1, 12), rng.randint(0, len(w))
        w[at:at] = ([rng.randrange(k) for _ in range(p)] * 90)[: rng.randint(1, 90)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        w, least, exponent = random_words(rng), rng.choice([24, 6, 3, 9]), rng.choice([3, 3, 4])
        assert runs_of(np.array(w, np.int64), least, exponent) == brute(w, least, exponent)


def test_long_runs_equal_brute_force(monkeypatch):
    import innkeep.llm.periodic_runs as module

    rng = random.Random(4)
    base = [rng.randrange(500) for _ in range(700)]
    w = base * 4 + [1] * 500 + ([1, 2] * 9 + [3]) * 20 + base[:100] * 5
    for held in (1 << 20, 10):
        monkeypatch.setattr(module, "HELD", held)
        assert runs_of(np.array(w, np.int64)) == brute(w)


def test_common_extensions_to_both_sides():
    rng = random.Random(5)
    for _ in range(80):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(2, 200))]
        w += w[: rng.randint(0, len(w))]
        i = np.array([rng.randrange(len(w) - 1) for _ in range(30)])
        j = np.array([rng.randrange(a + 1, len(w)) for a in i])
        grammar = Grammar(np.array(w))
        for a, b, ahead, back in zip(i, j, grammar.extend(i, j, 1), grammar.extend(i, j, -1)):
            assert ahead == next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b)
            assert back == next((k for k in range(a + 1) if w[a - k] != w[b - k]), a + 1)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digests(i, text):
    w = words_of(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, run_digests(periodic_runs(looped(docs))).collect()))
    assert got == sorted(digests(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_documents(spark, odd_docs):
    again = [(30, " ".join(["a b c"] * 30) + " x", None, None, 1, 2, "h"), (31, "é ß " * 40, None, None, 1, 2, "h"), (None, "z " * 99, None, None, 1, 2, "h")]
    docs = odd_docs.unionByName(spark.createDataFrame(again, odd_docs.schema))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, run_digests(periodic_runs(looped(docs))).collect()), key=key)
    assert got == sorted((digests(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_spans_and_texts_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "x  " + "a b c\n" * 9 + "d", "s")], "doc_id long, text string, runs string")
    row = periodic_runs(docs).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (29, [(1, 27, 3)], "x a b c d")
