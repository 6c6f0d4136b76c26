import collections

import pytest

from innkeep.llm import ngram_join
from innkeep.llm.graph import components
from innkeep.llm.ngram_join import jaccard_components, keep_one


def sets_of(rows, words):
    out = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    return out


def brute(rows, words, num, den):
    """(id, size, component) of every row, by comparing all pairs that share a shingle."""
    sets = sets_of(rows, words)
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    lists = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            shared = collections.Counter(j for x in s for j in lists[x])
            for j, c in shared.items():
                if den * c >= num * (len(s) + len(sets[j][1]) - c):
                    parent[find(k)] = find(j)
            for x in s:
                lists[x].append(k)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(s), low[find(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("words, num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(docs, words, num):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard_components(docs, words=words, num=num).collect()), key=str)
    assert got == brute(rows, words, num, 100)


def test_odd_rows(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard_components(odd_docs, words=3, num=90).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)
    assert jaccard_components(odd_docs.limit(0)).collect() == []


def test_a_family_of_near_copies_with_chains_and_unlinked_variants(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(80):  # each changes k % 7 words at places of its own
        w = list(base)
        for c in range(k % 7):
            w[(7 * k + 9 * c) % 60] = f"c{k}_{c}"
        rows.append((k, " ".join(w)))
    for k in range(12):  # a chain: neighbours link, ends don't
        rows.append((100 + k, " ".join(f"v{i}" for i in range(2 * k, 2 * k + 90))))
    rows += [(200 + k, "the common passage of many words that all of these share " * 3 + " ".join(f"u{k}_{i}" for i in range(40))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for words, num in ((3, 90), (5, 80)):
        got = sorted((tuple(r) for r in jaccard_components(df, words=words, num=num).collect()), key=str)
        assert got == brute(rows, words, num, 100)


def test_unlinked_pairs_are_settled_before_whole_sets_are_moved(spark, monkeypatch):
    rows = []
    for k in range(30):  # two texts that share two thirds of their words and no others'
        own = [[f"p{k}_{i}" if (i // 20) % 6 else f"q{k}_{i}_{j}" for i in range(600)] for j in range(2)]
        rows += [(2 * k + j, " ".join(w)) for j, w in enumerate(own)]
    made = {}

    def counted(df, path, written=ngram_join.written):
        out = written(df, path)
        made[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert got == brute(rows, 5, 80, 100)
    assert sum(c for name, c in made.items() if name.endswith("-pairs")) == 0
    assert made["open"] == 0


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark, odd_docs):
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # 3 twice the same text: one stays; 9 and 10 are near copies; empty texts are no copies
    assert ids == sorted([None, 3, 3, 1, 7, 9, 11, 12, 13], key=str)


def test_components_of_edges(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (20, 5), (8, 8)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 20: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
