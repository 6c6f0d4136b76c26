import collections
import math
import zlib

import numpy as np
import pyarrow as pa

from innkeep.llm import bytetext as bt
from innkeep.llm.suffix_tree import DEPTH, END, SEP, build, score_texts, sequence


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def check_counts_and_base(df, folds=5, held=1):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    is_held = [None if i is None else zlib.crc32(str(i).encode()) % folds == held for i, _ in rows]
    c = collections.Counter(t for (_, x), h in zip(rows, is_held) if h is False for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), str(h), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 6))
        for (i, x), h in zip(rows, is_held)
    )
    out = score_texts(df).collect()
    got = sorted((str(r.doc_id), str(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want
    return out


def test_counts_and_base_scores(docs):
    out = check_counts_and_base(docs)
    assert all(r.score < 0 for r in out)


def test_odd_rows(odd_docs):
    check_counts_and_base(odd_docs)
    assert score_texts(odd_docs.limit(0)).collect() == []


def test_rare_words_go_by_the_join(odd_docs, monkeypatch):
    import innkeep.llm.suffix_tree as module

    monkeypatch.setattr(module, "FREQUENT", 3)
    check_counts_and_base(odd_docs)


def test_symbols_of_a_text():
    data, offsets = bt.buffers(pa.array(["Ab  c", None]))
    seq, at, words, word_at = sequence(data, offsets)
    pad = [END] * DEPTH
    assert seq.tolist() == pad + [97, 98, SEP, 99, SEP, END] + pad + [END]
    assert at.tolist() == [0, DEPTH + 6, 2 * DEPTH + 7] and word_at.tolist() == [0, 2, 2]


def test_tree_is_a_distribution_and_scores_walk_the_longest_contexts(spark, docs):
    import innkeep.llm.suffix_tree as module

    texts = [r.text for r in docs.select("text").limit(60).collect()]
    data, offsets = bt.buffers(pa.array(texts))
    seq, at, _, _ = sequence(data, offsets)
    grams = collections.Counter()
    for a, b in zip(at, at[1:]):
        for k in range(a + DEPTH, b):
            grams[sum(int(seq[k - j]) << 8 * j for j in range(DEPTH + 1))] += 1
    tree = build(spark.createDataFrame(list(grams.items()), "key long, c long"))
    p = 10.0 ** tree.logp.astype(float)
    unused = 256 - (tree.step.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(1) + unused * p[:, -1], 1, atol=1e-4)
    assert tree.step.max() < len(tree.step) and len(tree.step) > 50
    got = tree.score(seq, at)
    for d in range(0, len(texts), 7):  # walked one symbol at a time from the root
        state = 0
        total = 0.0
        for k in range(at[d], at[d + 1]):
            col = tree.symbol[seq[k]]
            if k >= at[d] + DEPTH:
                total += float(tree.logp[state, col])
            state = tree.step[state, col]
        assert abs(total - got[d]) < 1e-6 * max(1, abs(total))
    assert module.CHUNK % 2 == 0


def test_known_patterns_score_better_than_the_unigram(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(words[(i + k) % 4] for k in range(60))) for i in range(200)]
    out = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.score > r.base_score for r in out if r.held_out)


def test_every_context_that_passes_is_retained(spark):
    """150 symbols before 150 others decide what follows: more contexts than any bound of the driver's."""
    a, b = "id div 150", "id % 150"
    grams = spark.range(22_500).selectExpr(f"(({a}) << 16) | (({b}) << 8) | ((id * 7919 + ({a}) * 31) % 150) AS key", "12L AS c")
    assert len(build(grams).step) == 1 + 150 + 22_500


def test_scores_are_those_of_the_whole_tree(spark, docs, monkeypatch):
    """With few n-grams broadcast, most scores come by the join; they equal the automaton's of the training texts."""
    import innkeep.llm.suffix_tree as module

    rows = [r for r in docs.select("doc_id", "text").collect()]
    data, offsets = bt.buffers(pa.array([r.text for r in rows]))
    seq, at, _, _ = sequence(data, offsets)
    grams = collections.Counter()
    for r, a, b in zip(rows, at, at[1:]):
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            for k in range(a + DEPTH, b):
                grams[sum(int(seq[k - j]) << 8 * j for j in range(DEPTH + 1))] += 1
    want = dict(zip((r.doc_id for r in rows), build(spark.createDataFrame(list(grams.items()), "key long, c long")).score(seq, at)))
    for most in (100, module.FREQUENT_GRAMS):
        monkeypatch.setattr(module, "FREQUENT_GRAMS", most)
        got = {r.doc_id: r.score for r in score_texts(docs).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 * abs(want[i]) for i in want)
