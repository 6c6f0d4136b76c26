"""Benchmark decontamination with a distributed positional inverted index.

Test texts are cut into windows of ``n`` consecutive words.  Their terms are
counted in the training texts; the index then stores the postings
``(word, document, position)`` of the two rarest terms of every window.  The
rarest term's list, shifted by its offset in the window, gives candidate
starts; the second list, shifted likewise, intersects them; what is left is
compared word by word with the text.  DataFrame operations only.

Words: ASCII letters are lower-cased, words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Edge cases: null and empty texts have no words; an item of fewer than ``n``
words is one window; items without words or id are not searched; rows without
an id get results too; rows equal in id and text share one result; items that
share an id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import checked, cut, new_path, remove, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    # lower() touches ASCII letters only when all characters are ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), NOT_WORD), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, did, h, text``: (did, h) tells rows apart by id and text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.withColumn("did", F.coalesce("id", F.lit(0).cast("long"))).withColumn("h", F.xxhash64(F.col("id").isNull(), "text"))


def windows(bench: DataFrame, docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``item, key, w, size, terms, first, second``: windows that may occur in ``docs(text)``, with their two rarest terms.

    ``first`` and ``second`` are ``(count, offset, word)``; ``terms`` are the window's words in order.
    """
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("ws")).where("item is not null and size(ws) > 0")
    items = items.withColumn("key", F.xxhash64("item", "ws")).dropDuplicates(["key"])
    terms = items.select("item", "key", F.size("ws").alias("m"), F.posexplode("ws").alias("at", "word"))
    vocabulary = cut(terms.select("word").distinct())
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(checked(vocabulary), "word").groupBy("word").agg(F.count("*").alias("c"))
    spread = terms.join(counts, "word").withColumn(
        "w", F.explode(F.expr(f"sequence(greatest(0, at - {n - 1}), least(at, greatest(0, m - {n})))"))
    )
    out = spread.groupBy("item", "key", "w", F.least("m", F.lit(n)).alias("size")).agg(
        F.sort_array(F.collect_list(F.struct("c", (F.col("at") - F.col("w")).alias("offset"), "word"))).alias("t")
    )
    out = out.where("size(t) = size")  # a term that no document has rules the window out
    by_place = F.transform(F.array_sort(F.transform("t", lambda x: F.struct(x.offset.alias("o"), x.word.alias("word")))), lambda x: x.word)
    return out.select("item", "key", "w", "size", by_place.alias("terms"), F.col("t")[0].alias("first"), F.expr("t[least(1, size - 1)]").alias("second"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of ``docs(did, h, text)`` for the words of ``terms(word)``: ``word, did, h, pos``."""
    every = docs.select("did", "h", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return every.join(checked(terms), "word").select("word", "did", "h", "pos")


def _intersect(index: DataFrame, tests: DataFrame, slop: int = 0) -> DataFrame:
    """Windows whose rarest two terms stand in a document at their distance, give or take ``slop``."""
    start = (F.col("pos") - F.col("first.offset")).alias("start")
    found = index.join(tests.withColumn("word", F.col("first.word")), "word").select("did", "h", "item", "key", "w", "size", "second", start)
    found = found.where("start >= 0")
    place = F.col("start") + F.col("second.offset")
    if slop:
        found = found.withColumn("shift", F.explode(F.expr(f"sequence(-{slop}, {slop})")))
        place = place + F.col("shift")
    found = found.withColumn("pos", place).withColumn("word", F.col("second.word"))
    return found.join(index.select("word", "did", "h", "pos"), ["did", "h", "pos", "word"]).drop("second", "word", "pos")


def _setup(docs: DataFrame, bench: DataFrame, n: int, id_col: str, text_col: str, item_col: str, root: str):
    base = _keyed(docs, id_col, text_col)
    tests = written(windows(bench, base, n, item_col, text_col), f"{root}/windows")
    rare = cut(tests.select(F.explode(F.array("first.word", "second.word")).alias("word")).distinct())
    return base, tests, written(postings(base, rare), f"{root}/index")


def proximity(docs: DataFrame, bench: DataFrame, n: int = 10, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col, item, w, start, gap``: windows whose two rarest terms are at most ``slop`` words off their distance."""
    root = new_path(docs.sparkSession, "proximity")
    base, tests, index = _setup(docs, bench, n, id_col, text_col, item_col, root)
    near = _intersect(index, tests, slop).groupBy("did", "h", "item", "w", "start").agg(F.min(F.abs("shift")).alias("gap"))
    ids = base.select("id", "did", "h").join(near, ["did", "h"])
    out = cut(ids.select(F.col("id").alias(id_col), "item", "w", "start", "gap"))
    remove(docs.sparkSession, root)
    return out


def phrase_hits(base: DataFrame, tests: DataFrame, index: DataFrame) -> DataFrame:
    """``did, h, item, start, size``: every occurrence of a window."""
    found = _intersect(index, tests).select("did", "h", "item", "key", "w", "size", "start").distinct()
    found = cut(found.join(tests.select("key", "w", "terms"), ["key", "w"]).select("did", "h", "item", "start", "size", "terms"))
    ids = found.select("did", "h").distinct()
    wanted = found.groupBy("did", "h").agg(F.collect_list(F.struct("item", "start", "size", "terms")).alias("todo"))
    texts = base.select("did", "h", "text").join(checked(ids), ["did", "h"], "left_semi").dropDuplicates(["did", "h"])
    both = texts.join(wanted, ["did", "h"]).select("did", "h", words(F.col("text")).alias("ws"), "todo")
    hits = both.select("did", "h", F.explode(F.expr("filter(todo, x -> slice(ws, x.start + 1, x.size) = x.terms)")).alias("x"))
    return hits.select("did", "h", "x.item", "x.start", "x.size")


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per input row: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` and the occurrences ``spans``.

    A word inside any occurrence of a window is hit; ``spans`` lists ``(item,
    start, size)`` in order.
    """
    spark = docs.sparkSession
    root = new_path(spark, "positional-index")
    base, tests, index = _setup(docs, bench, n, id_col, text_col, item_col, root)
    hits = phrase_hits(base, tests, index)
    per = hits.groupBy("did", "h").agg(F.array_sort(F.collect_set(F.struct("start", "size", "item"))).alias("spans"))
    # words in the union of the spans, which are in order of start
    covered = F.expr(
        "aggregate(spans, named_struct('end', 0, 'n', 0L), "
        "(a, x) -> named_struct('end', greatest(a.end, x.start + x.size), 'n', a.n + greatest(0, x.start + x.size - greatest(x.start, a.end))), a -> a.n)"
    )
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda x: x.item)))
    per = per.select("did", "h", "spans", covered.alias("n_hit"), items.alias("items"))
    all_rows = base.select("id", "did", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = all_rows.join(per, ["did", "h"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.transform("spans", lambda x: F.struct(x.item.alias("item"), x.start.alias("start"), x.size.alias("size"))).alias("spans"),
    )
    out = cut(out)
    remove(spark, root)
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no window of a benchmark item occurs."""
    spark = docs.sparkSession
    root = new_path(spark, "positional-index")
    base, tests, index = _setup(docs, bench, n, id_col, text_col, item_col, root)
    hit = cut(phrase_hits(base, tests, index).select(F.col("did").alias("hit_did"), F.col("h").alias("hit_h")).distinct())
    remove(spark, root)
    i = docs[id_col].cast("long")
    did, h = F.coalesce(i, F.lit(0).cast("long")), F.xxhash64(i.isNull(), docs[text_col].cast("string"))
    rows = docs.select(F.struct(*docs.columns).alias("r"), did.alias("did"), h.alias("h"))
    return rows.join(checked(hit.toDF("did", "h")), ["did", "h"], "left_anti").select("r.*")
