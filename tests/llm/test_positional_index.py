import hashlib
import re

from innkeep.llm.positional_index import decontaminate, drop_contaminated, proximity

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").encode().lower())


def brute(docs, bench, n=10):
    wins = {}
    for i, t in bench.select("item_id", "text").collect():
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - n + 1)):
                wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs.select("doc_id", "text").collect():
        w, hit, items = words(t), set(), set()
        for size in {len(k) for k in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    items |= wins[tuple(w[k : k + size])]
                    hit.update(range(k, k + size))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(docs, bench):
    return sorted((tuple(r)[:6] for r in decontaminate(docs, bench).collect()), key=str)


def test_equals_brute_force(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute(docs, bench)
    assert got(docs, bench) == want and any(r[5] for r in want)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[5])


def test_odd_rows_short_items_repeats_and_ties(spark, odd_docs):
    text = "one two three four five six seven eight nine ten eleven twelve one two three"
    docs = odd_docs.unionByName(spark.createDataFrame([(20, text, None, None, 1, 2, "h"), (21, "the the the the the the the the the the the the", None, None, 1, 2, "h"), (22, "É É a B", None, None, 1, 2, "h")], odd_docs.schema))
    items = [(1, "x y"), (1, "Z"), (2, "É a"), (3, text[:54]), (None, "x"), (5, None), (6, "one two three"), (6, "one two three"), (7, "the the the the the the the the the the the"), (8, ""), (9, "x y z w")]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, w int")
    want = brute(docs, bench)
    assert got(docs, bench) == want and sum(r[5] for r in want) >= 4
    assert decontaminate(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "a rareone b c raretwo d"), (2, "a rareone raretwo"), (3, "rareone x x x x x x raretwo"), (4, "a b c d b b b b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rareone b raretwo")], "item_id long, text string")
    near = {(r.doc_id, r.gap) for r in proximity(docs, bench, slop=2).collect()}
    assert {i for i, _ in near} == {1, 2}
