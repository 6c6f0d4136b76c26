"""Exact length histogram of a corpus and the answers its suffix sums give.

Documents are counted by encoded length in the map tasks, so what is shuffled
and stored is one row per distinct length.  Suffix sums over that table answer,
for a context limit L: documents longer than L, tokens kept when each document
is cut at L, and tokens lost; prefix sums answer totals and quantiles.

Edge cases: null text counts as the empty text (length 0, or 1 with an end
id); an empty table gives an empty table and no quantiles; every input row
counts, also repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytetext as bt
from .encoder import encoder, public_path
from .storage import cut

BLOCK = 1024  # lengths per block of the two-level sums


def _lengths(path: str, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for _, _, data, offsets in bt.text_slices(batch):
                _, at = encoder(path).encode(data, offsets)
                for n, c in zip(*np.unique(np.diff(at) + extra, return_counts=True)):
                    seen[int(n)] = seen.get(int(n), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", end_tokens: int = 0) -> DataFrame:
    """``(n_tokens, docs)``: how many documents have each encoded length."""
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    parts = text.mapInArrow(_lengths(tokenizer or public_path(), end_tokens), "n_tokens long, docs long")
    return parts.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def sums(hist: DataFrame) -> DataFrame:
    """Per length L of the histogram: ``n_tokens, docs, docs_le, tokens_le, docs_gt, tokens_gt, total_docs, total_tokens,
    kept_tokens`` (all documents cut at L) and ``quantile`` (share of documents of at most L).

    Sums run within blocks of lengths and over the block totals, so no task
    holds more than a block or the list of blocks.
    """
    hist = cut(hist)  # read twice below; a row per length
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("t").alias("btk"))
    upto, whole = Window.orderBy("block"), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        (F.sum("bd").over(upto) - F.col("bd")).alias("d0"), (F.sum("btk").over(upto) - F.col("btk")).alias("t0"),
        F.sum("bd").over(whole).alias("total_docs"), F.sum("btk").over(whole).alias("total_tokens"),
    )
    inner = Window.partitionBy("block").orderBy("n_tokens")
    h = h.withColumn("d1", F.sum("docs").over(inner)).withColumn("t1", F.sum("t").over(inner)).join(blocks, "block")
    out = h.select("n_tokens", "docs", (F.col("d0") + F.col("d1")).alias("docs_le"), (F.col("t0") + F.col("t1")).alias("tokens_le"), "total_docs", "total_tokens")
    out = out.withColumn("docs_gt", F.col("total_docs") - F.col("docs_le")).withColumn("tokens_gt", F.col("total_tokens") - F.col("tokens_le"))
    return out.withColumn("kept_tokens", F.col("tokens_le") + F.col("docs_gt") * F.col("n_tokens")).withColumn(
        "quantile", F.col("docs_le") / F.col("total_docs")
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_gt, kept_tokens, lost_tokens`` for the given context limits (also lengths that no document has)."""
    h = hist.select("n_tokens", "docs", F.explode(F.array([F.lit(int(x)).cast("long") for x in sorted(set(limits))])).alias("limit"))
    return h.groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("docs")).otherwise(0)).alias("docs_gt"),
        F.sum(F.least("n_tokens", "limit") * F.col("docs")).alias("kept_tokens"),
        F.sum(F.greatest(F.col("n_tokens") - F.col("limit"), F.lit(0)) * F.col("docs")).alias("lost_tokens"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of documents don't exceed."""
    table = sums(hist).select("n_tokens", "quantile")
    rows = [table.where(F.col("quantile") >= float(q)).agg(F.lit(float(q)).alias("share"), F.min("n_tokens").alias("n_tokens")) for q in shares]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out.where("n_tokens is not null")


def length_table(docs: DataFrame, tokenizer: str | None = None, end_tokens: int = 0) -> DataFrame:
    """:func:`sums` of the documents' histogram: the answer for every limit that matters."""
    return sums(histogram(docs, tokenizer, end_tokens=end_tokens))
