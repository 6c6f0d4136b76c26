"""Row-keeping operators leave columns alone whose names they use themselves."""

import pytest
from pyspark.sql import functions as F

from innkeep.llm.cube_mix import mixed_rows
from innkeep.llm.exact_copies import drop_copies
from innkeep.llm.language_crf import fit_sample, keep_identified
from innkeep.llm.line_join import dedup_lines
from innkeep.llm.ngram_join import keep_one
from innkeep.llm.positional_index import drop_contaminated

NAMES = """r place i t s copy copies row near_row near_text near_id mix_row mix_copy mix_id mix_src mix_text src size source_size target taken h salt
did hit_did hit_h ws todo item start id line line_row line_lost removed n n_shingles component_id digest body keep_id group_size kept word words
lang_pred score held_out m k l whole p rate block""".split()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in NAMES])


def operators(docs, bench):
    model = fit_sample(docs)
    yield "keep_identified", lambda d: keep_identified(d, model=model)
    yield "keep_one", keep_one
    yield "drop_contaminated", lambda d: drop_contaminated(d, bench)
    yield "mixed_rows", mixed_rows
    yield "dedup_lines", dedup_lines
    yield "drop_copies", drop_copies


def test_columns_of_any_name_stay(spark, docs, wide):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, run in operators(docs, bench):
        got, plain = run(wide), run(docs)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in NAMES), name
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect()), name
