import numpy as np

from innkeep.llm.language_crf import chain_posteriors, fit_sample, identify, keep_identified, label_words


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    t = rng.random((3, 3))
    at = np.array([0, 0, 5, 205, 206, 270])
    e = rng.random((270, 3))
    p = chain_posteriors(e, at, t)
    for a, b in zip(at, at[1:]):
        alpha, v = [], np.full(3, 1 / 3)
        for k in range(a, b):
            v = (v @ t) * e[k]
            v /= v.sum()
            alpha.append(v)
        w = np.ones(3)
        for k in range(b - 1, a - 1, -1):
            q = alpha[k - a] * w
            assert np.allclose(q / q.sum(), p[k], atol=1e-9)
            w = t @ (w * e[k])
            w /= w.sum()


def test_held_out_accuracy_and_code_switching(spark, docs):
    model = fit_sample(docs)
    rows = identify(docs, model=model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.lang: r.text for r in docs.where("lang in ('en', 'fr')").dropDuplicates(["lang"]).collect()}
    en, fr = (" ".join(by[k].split()[:12]) for k in ("en", "fr"))
    mixed = spark.createDataFrame([(1, f"{en} {fr}")], "doc_id long, text string")
    labels = [w.lang for w in label_words(mixed, model).collect()[0].words]
    half = len(labels) // 2
    assert labels[: half - 3].count("en") >= half - 5 and labels[half + 3 :].count("fr") >= half - 5


def test_odd_rows(spark, docs, odd_docs):
    model = fit_sample(docs)
    rows = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in identify(odd_docs, model=model).collect()}
    und = {k for (k, _), v in rows.items() if v == ("und", 0.0)}
    assert und >= {1, 7, 11} and None not in und and 9 not in und
    assert identify(odd_docs.limit(0)).collect() == []
    nothing = odd_docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {(r.lang_pred, r.score) for r in identify(nothing).collect()} == {("und", 0.0)}
    kept = keep_identified(odd_docs, model=model)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 9, 10, 12, 13} and kept.where("doc_id in (1, 7, 11)").isEmpty()


def test_code_switched_and_short_texts_stay(spark, docs):
    model = fit_sample(docs)
    by = {r.lang: r.text.split() for r in docs.where("lang is not null and length(text) > 200").dropDuplicates(["lang"]).collect()}
    assert len(by) == 4
    langs = sorted(by)
    texts = [" ".join(w for l in langs[:n] for w in by[l][:24]) for n in (2, 3, 4)]
    texts += [" ".join(w for k in range(0, 24, 6) for l in langs for w in by[l][k : k + 6]), "ok", "Zyx qwv", "one", "résumé"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    scores = {r.doc_id: r.score for r in identify(rows, model=model).collect()}
    assert min(scores.values()) < 0.4  # what a bound on the mean posterior would lose
    assert sorted(r.doc_id for r in keep_identified(rows, model=model).collect()) == list(range(len(texts)))
