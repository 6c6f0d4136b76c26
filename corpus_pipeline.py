"""Corpus pipeline over ``documents``: each stage is one operator of ``innkeep.llm``.

Stages in order: rows without a determinable language go; of near duplicates
(five-word shingles, Jaccard 0.8) one row stays; rows that hold a ten-word
window of a benchmark item go; sources are mixed to their target weights, a row
being repeated as often as the mix takes it; token-ID files are written, read
back and described per row.

A stage takes what its predecessor kept, all of it, as a Parquet table, and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from innkeep.llm.cube_mix import mixed_rows
from innkeep.llm.language_crf import keep_identified
from innkeep.llm.ngram_join import keep_one
from innkeep.llm.positional_index import drop_contaminated
from innkeep.llm.storage import new_path, remove, ship, written
from innkeep.llm.token_store import round_trip


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the random field determines."""
    ship(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    ship(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages."""
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as the mix of sources takes them."""
    ship(spark)
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the token-ID files."""
    ship(spark)
    return round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Stages 1, 2, 4 and 5 can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
