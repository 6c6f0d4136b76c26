import zlib

import corpus_pipeline as P
from innkeep.llm.encoder import encode_texts, public_path
from innkeep.llm.storage import new_path, written

from .test_cube_mix import plain_targets
from .test_ngram_join import brute as groups_of
from .test_positional_index import brute as contamination_of

SF = "/root/testdata/sf0.001"


def test_each_stage_by_its_own_input(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, rows = docs.columns, docs
    kept = {}
    for name, stage in P.STAGES:
        rows = written(stage(spark, rows, SF), new_path(spark, name))
        kept[name] = rows
        if name != "token_ids":
            assert rows.columns == columns
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in kept.items()}
    before = sorted(r.doc_id for r in docs.collect())
    letters = sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert set(ids["language_id"]) <= set(letters) and len(ids["language_id"]) >= 0.97 * len(letters) and len(before) == 200
    groups = groups_of([(r.doc_id, r.text) for r in kept["language_id"].collect()], 5, 80, 100)
    assert ids["near_duplicates"] == sorted(i for i, _, c in groups if i == c)
    dirty = contamination_of(kept["near_duplicates"], bench)
    assert ids["decontamination"] == sorted(r[0] for r in dirty if not r[5])
    size = {}
    for r in kept["decontamination"].collect():
        size[r.source] = size.get(r.source, 0) + len(r.text.encode().split())
    taken = {}
    for r in kept["source_mix"].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
    for s, t in plain_targets(size).items():
        assert abs(taken.get(s, 0) - t) < 400
    texts = sorted(((r.doc_id, r.text) for r in kept["source_mix"].collect()))
    want = sorted((i, len(x) + 1, zlib.crc32(b"".join(k.to_bytes(4, "little") for k in [*x, 0]))) for (i, _), x in zip(texts, encode_texts(public_path(), [t for _, t in texts])))
    got = kept["token_ids"].collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_stages_take_odd_rows_and_an_empty_table(spark, odd_docs):
    rows = odd_docs
    for name, stage in P.STAGES:
        rows = written(stage(spark, rows, SF), new_path(spark, name))
    assert rows.count() > 0
    rows = odd_docs.limit(0)
    for name, stage in P.STAGES:
        rows = written(stage(spark, rows, SF), new_path(spark, name))
    assert rows.count() == 0
