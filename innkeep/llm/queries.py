"""Registered queries of the subpackage: ``(spark, sf_dir) -> DataFrame``.

Each takes its whole table through one operator with production parameters.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import ship


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11 = """
WITH f AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.rn AS anchor, a.vec_id AS anchor_id, c.rn AS other, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM f a JOIN f c ON a.vec_id % 50 = 0 AND a.rn <> c.rn
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) AS k FROM pairs WHERE same) WHERE k <= 5
), ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id, n.other) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

OP13 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
), r AS (
  SELECT *, row_number() OVER (PARTITION BY body, doc_id) AS copy FROM n
)
SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id IS NOT DISTINCT FROM g.keep_id AND r.copy = 1 AS kept, sha256(body) AS text_sha256
FROM r JOIN g USING (body)
"""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g
  FROM d
), c AS (
  SELECT row_number() OVER () AS cid, g, len(g) AS n, min(doc_id) AS low FROM s WHERE len(g) > 0 GROUP BY g
), t AS (
  SELECT cid, n, unnest(g) AS x FROM c
), e AS (
  SELECT a.cid AS a, b.cid AS b FROM t a JOIN t b ON a.x = b.x AND a.cid <> b.cid AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT cid AS a, cid AS b FROM c
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (
  SELECT r.a AS cid, min(c.low) AS component_id FROM r JOIN c ON c.cid = r.b GROUP BY r.a
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN k USING (cid)
"""

OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), occ AS (
  SELECT rn, i, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT rn, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN (SELECT DISTINCT m FROM win) ON len(w) >= m)
), hit AS (
  SELECT rn, i, m, item_id FROM occ JOIN win USING (x, m)
), words AS (
  SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rn
), items AS (
  SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rn) LEFT JOIN items USING (rn)
"""

OP10 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, text FROM documents
), l AS (
  SELECT rn, doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS body
  FROM (SELECT rn, doc_id, string_split({LOW}, chr(10)) AS a FROM d WHERE text IS NOT NULL)
), s AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) AS g, row_number() OVER (ORDER BY doc_id, line, rn) AS place FROM l
), c AS (
  SELECT g, min(place) AS place, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g
), t AS (
  SELECT place, n, unnest(g) AS x FROM c
), f AS (
  SELECT x, count(*) AS c FROM t GROUP BY x
), p AS (
  SELECT place, n, x FROM (SELECT place, n, x, row_number() OVER (PARTITION BY place ORDER BY c, x) AS k FROM t JOIN f USING (x)) WHERE k <= n - (80 * n + 99) // 100 + 1
), m AS (
  SELECT DISTINCT a.place, b.place AS before FROM p a JOIN p b ON a.x = b.x AND b.place < a.place AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), gone AS (
  SELECT DISTINCT m.place FROM m JOIN c a ON a.place = m.place JOIN c b ON b.place = m.before
  WHERE 100 * len(list_intersect(a.g, b.g)) >= 80 * (a.n + b.n - len(list_intersect(a.g, b.g)))
), marked AS (
  SELECT s.rn, s.body, len(s.g) > 0 AND (c.place IS NULL OR gone.place IS NOT NULL) AS removed FROM s LEFT JOIN c ON c.place = s.place LEFT JOIN gone ON gone.place = s.place
), sums AS (
  SELECT rn, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, sum(length(body)) FILTER (NOT removed) AS chars FROM marked GROUP BY rn
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS kept_chars
FROM d LEFT JOIN sums USING (rn)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 inner products for every twentieth vector, against all vectors."""
    from .topk_search import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard 0.9, components over all documents."""
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    from .language_crf import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as ranked variable-length codes and read back."""
    from .token_store import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents, learned from the training fold."""
    from .suffix_tree import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weighted source targets."""
    from .cube_mix import mix

    return mix(_table(spark, sf_dir, "documents")).drop("copies")


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired to a legal one at least cost, rendered turn by turn."""
    from .role_repair import repair_roles

    return repair_roles(_table(spark, sf_dir, "conversations"))


def op8_token_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantile rank and truncated totals at every length of the corpus."""
    from .length_histogram import length_table

    return length_table(_table(spark, sf_dir, "documents"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items."""
    from .positional_index import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that an earlier line matches with Jaccard 0.8 or more."""
    from .line_join import line_counts

    return line_counts(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on."""
    from .hard_negatives import mine

    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where every tenth text (by crc32 of the id) repeats a stretch of its words to its end.

    With h the checksum and g = h div 10, n words: from word a = g % n on, word
    i becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).  Other
    texts, and those of null ids, are left as they are.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), F.crc32(F.col(id_col).cast("string")).alias("h"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, int(g % n), 0)")).withColumn("p", F.expr("if(n > 0, int(1 + (n - a) div (3 + g % 8)), 1)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> if(i < a, w[i], w[a + (i - a) % p])), ' ')")
    return rows.select(id_col, F.when(F.col("n") > 0, again).otherwise(F.col(text_col)).alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The run of greatest exponent, and digests of all runs and of the collapsed text."""
    better: Callable[[Column, Column], Column] = lambda b, r: b.isNull() | (r.length * b.period > b.length * r.period)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    rows = found.select(id_col, "runs", "collapsed", best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, every tenth document looped."""
    from .periodic_runs import periodic_runs

    return run_digests(periodic_runs(looped(_table(spark, sf_dir, "documents"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, kept row and digest of every document by its whole normalised text."""
    from .exact_copies import copy_groups

    groups = copy_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run over the documents of ``sf_dir``."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def _runner(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered name -> query."""
    own = {k: v for k, v in globals().items() if k[:2] == "op" and k[2].isdigit()} | {"pipeline": pipeline}
    return {k: _runner(v) for k, v in own.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_pivot_top_k": OP1, "op2_ngram_jaccard_join": OP2, "op9_positional_index": OP9, "op10_line_dedup": OP10, "op11_hard_negatives": OP11, "op13_exact_dedup": OP13}
