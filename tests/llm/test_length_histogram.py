from innkeep.llm.encoder import encode_texts, public_path
from innkeep.llm.length_histogram import at_limits, histogram, length_table, quantiles


def check(df):
    lengths = sorted(len(x) for x in encode_texts(public_path(), [r.text for r in df.select("text").collect()]))
    n, total = len(lengths), sum(lengths)
    rows = {r.n_tokens: r for r in length_table(df).collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        below = [x for x in lengths if x <= limit]
        assert (r.docs, r.docs_le, r.tokens_le) == (lengths.count(limit), len(below), sum(below))
        assert (r.total_docs, r.total_tokens, r.docs_gt, r.tokens_gt) == (n, total, n - len(below), total - sum(below))
        assert r.kept_tokens == sum(min(x, limit) for x in lengths) and abs(r.quantile - len(below) / n) < 1e-12
    return lengths


def test_sums_limits_and_quantiles(docs):
    lengths = check(docs)
    hist = histogram(docs).cache()
    wanted = [0, 17, 1000, 10**7]
    for r in at_limits(hist, wanted).collect():
        kept = sum(min(x, r.limit) for x in lengths)
        assert (r.docs_gt, r.kept_tokens, r.lost_tokens) == (sum(x > r.limit for x in lengths), kept, sum(lengths) - kept)
    for r in quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= r.share)


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert length_table(odd_docs.limit(0)).collect() == []
