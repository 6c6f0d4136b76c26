"""Exact dedup by skew-safe combining.

Texts are equal when identical after every run of white space
(`[\\x20\\x09-\\x0D]+`) became one space.  DataFrame operations only:

1. each task combines its own equal texts (the map side of an aggregation whose
   key is digest, salt and the whole text): a group of copies leaves a task as
   at most one row a salt;
2. the rows of one digest and salt meet and are combined, so a hot group is
   ``SALTS`` reducers' work, each over one row a task;
3. the at most ``SALTS`` winners of a text are combined into one class, again
   with the whole text in the key.  Its smallest id stays.

Every stage compares whole texts.  Documents then find their class by digest
and salt, ids and digests only: that is exact for each digest that stage 3 left
with a single text.  Digests with several texts (none is known for SHA-256) are
looked for, and their documents find their class by the whole text.

Edge cases: null text counts as empty; null ids come after all others (a group
of null ids alone has a null ``keep_id``); of rows equal in id and text one is
the kept one; an empty table gives an empty table; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .storage import cut

SALTS = 32  # at most 64: a class notes its salts in a long
COPIES = 1024  # rows that one step of unfolding repeated rows makes
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text that is compared."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _classes(rows: DataFrame) -> DataFrame:
    """``digest, body, keep_id, group_size, salts`` (a bit for each salt) of the distinct texts of ``rows``."""
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))
    return salted.groupBy("digest", "body").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(bit).alias("salts"))


def _unfolded(rows: DataFrame) -> DataFrame:
    """``rows`` as often as their ``copies`` say, numbered by ``copy`` from 0; arrays stay small."""
    rows = rows.withColumn("base", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).withColumn("base", F.col("base") * COPIES)
    return rows.withColumn("copy", F.explode(F.sequence("base", F.least(F.col("base") + COPIES, F.col("copies")) - 1)))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of the normalised text."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), normalised(docs[text_col]).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    classes = cut(_classes(rows).select("digest", "keep_id", "group_size", "salts"))
    clash = classes.groupBy("digest").count().where("count > 1").select("digest")
    sole, clashing = classes, not clash.isEmpty()
    if clashing:
        clash = cut(clash)
        sole = classes.join(clash, "digest", "left_anti")
    salt = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1))
    # each (digest, salt) holds a share of a hot group, never all of it
    ids = rows.groupBy("digest", "salt", "id").agg(F.count("*").alias("copies"))
    found = ids.join(sole.select("digest", salt.alias("salt"), "keep_id", "group_size"), ["digest", "salt"])
    found = found.select("id", "digest", "keep_id", "group_size", "copies")
    if clashing:
        same = rows.join(clash, "digest", "left_semi")
        ids = same.groupBy("digest", "salt", "body", "id").agg(F.count("*").alias("copies"))
        whole = _classes(same).select("digest", salt.alias("salt"), "body", "keep_id", "group_size")
        found = found.unionByName(ids.join(whole, ["digest", "salt", "body"]).select("id", "digest", "keep_id", "group_size", "copies"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return _unfolded(found).select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are.

    Of rows equal in id and text, which no rule tells apart, one stays.
    """
    stays = copy_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), "digest")
    rows = docs.select(docs[id_col].cast("long").alias("id"), sha256(normalised(docs[text_col])).alias("digest"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = rows.alias("r").join(stays.alias("s"), F.col("r.digest").eqNullSafe(F.col("s.digest")) & F.col("r.id").eqNullSafe(F.col("s.id")), "left_semi")
    one = same.groupBy("id", "digest").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
