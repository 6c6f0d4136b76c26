import duckdb

import __spark_entry__ as E
from innkeep.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator_and_the_pipeline():
    names = set(Q.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert names <= set(E.queries()) and set(Q.oracle_sql()) <= set(E.oracle_sql())


def test_oracles(spark):
    for name, sql in Q.oracle_sql().items():
        con = duckdb.connect()
        for table in ("embeddings", "documents", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
        got = [tuple(r) for r in Q.queries()[name](spark, SF).select(*names).collect()]
        assert sorted(got) == sorted(want) and got


def test_contract_columns(spark):
    want = {
        "op2_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
        "op3_language_crf": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op6_cube_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op9_positional_index": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
        "op13_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    }
    for name, columns in want.items():
        df = Q.queries()[name](spark, SF)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
        assert df.count() == 200
