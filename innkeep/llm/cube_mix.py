"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document of the source the same
wanted number of repeats: a whole part, and a fractional inclusion
probability.  The fractions become 0 or 1 by the cube method: a flight phase
moves the probabilities along the null space of the balancing constraints
(documents and words of the source), so both totals stay as they are, until
fewer undecided documents than constraints are left; the landing rounds those.

The flight runs per block of a source (blocks by a hash of the row, about
``BLOCK`` documents each).  The one or two documents that a block leaves go on
to blocks of the next level, until one block per source remains.  There the
larger documents are decided first, and the landing problem has the source's
smallest, about a dozen.  So no task ever holds a source.

Edge cases: null, empty and blank texts have size 0; they count as documents
in the balance but not in words.  A null source is a source of its own, last
in order.  Repeated rows are separate documents.  An empty table gives an
empty table; if no text has words, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytetext as bt
from .storage import cut

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK = 4096
HELD = 10  # documents of a source that the last flight leaves to the landing
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move probabilities ``p`` to 0 or 1 keeping ``sum(p)`` and ``sum(p * x)``; at most two stay undecided.

    Three undecided units at a time: the null space of the two constraints
    is the cross product of their rows.  Which end point of the line through p
    is taken is drawn so that every unit keeps its expectation; the draws come
    from ``seed`` alone, so reruns agree.
    """
    draws = np.random.default_rng(seed).random(len(p)).tolist()
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    open_: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if not any(u):  # equal sizes: one of them gives to another
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(open_, u) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(open_, u) if v)
            step = up if draws[i] * (up + down) < down else -down
            rest = []
            for k, v in zip(open_, u):
                p[k] += step * v
                if EPS < p[k] < 1 - EPS:
                    rest.append(k)
                else:
                    p[k] = float(round(p[k]))
            open_ = rest
            if len(open_) == 3:  # rounding kept all three inside by a hair: the nearest is decided
                k = min(open_, key=lambda j: min(p[j], 1 - p[j]))
                p[k] = float(round(p[k]))
                open_.remove(k)
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the last few units (up to ``HELD`` + 2): of all choices the one whose words, then documents, come nearest."""
    p, x = p.astype(float), x.astype(float)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(picks @ x[open_] - (p[open_] * x[open_]).sum())
    docs = np.abs(picks.sum(1) - p[open_].sum())
    out = np.round(p)
    out[open_] = picks[np.argmin(words / max(1.0, x.mean() if len(x) else 1.0) + docs / 100)]
    return out


def settle(p: np.ndarray, x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Decide all units of a source's last block, its words kept within about its smaller documents.

    The largest eighth of the units flies; what stays undecided among them,
    which no smaller unit could balance, is rounded, and the words it is off by
    go to all smaller units: their probabilities move by one step.  So on with
    the next eighth, until the smallest units are left for the landing.
    """
    order = np.lexsort((np.arange(len(x)), -x))
    p, x = p[order].astype(float), x[order].astype(float)
    i = 0
    while len(p) - i > HELD + 2:
        j = i + -(-(len(p) - i) // 8)
        want = (p[i:] * x[i:]).sum()
        p[i:j] = np.round(flight(p[i:j], x[i:j], seed + i))
        want -= (p[i:j] * x[i:j]).sum()
        low, high = -1.0, 1.0
        for _ in range(50):
            step = (low + high) / 2
            low, high = (step, high) if (np.clip(p[j:] + step, 0, 1) * x[j:]).sum() < want else (low, step)
        p[j:] = np.clip(p[j:] + high, 0, 1)
        i = j
    out = np.empty(len(p))
    out[order] = landing(p, x)
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bt.count_words(batch.column(batch.num_columns - 1)))], names=[*batch.schema.names[:-1], "size"])


def add_targets(per: DataFrame) -> DataFrame:
    """``target`` for one row per source (``mix_src, source_size``): shares of all words by weight, none above
    ``MOST_REPEATS`` times its words.

    Sources above their cap stop there and the rest is shared anew; a share
    per unit of weight only rises, so the number alone tells who is capped,
    and each turn is one aggregate.
    """
    place = F.row_number().over(Window.orderBy(F.col("mix_src").asc_nulls_last())) - 1  # one row per source name
    weight = F.element_at(F.array([F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    per = cut(per.withColumn("weight", weight.cast("double")))
    unit, capped = 0.0, -1
    while True:
        above = F.col("weight") * unit > MOST_REPEATS * F.col("source_size")
        r = per.agg(
            F.count_if(above).alias("n"),
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, MOST_REPEATS * F.col("source_size")).otherwise(0)).alias("taken"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        if r["n"] == capped or not r["w"]:
            break
        unit, capped = (r["all"] - r["taken"]) / r["w"], r["n"]
    above = F.col("weight") * unit > MOST_REPEATS * F.col("source_size")
    share = F.when(above, (MOST_REPEATS * F.col("source_size")).cast("double")).otherwise(F.col("weight") * unit)
    return per.withColumn("target", share)


def _decide(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "row"])
        seed = int(pdf["h"].to_numpy().view(np.uint64).sum())
        pdf["p"] = (settle if last else flight)(pdf["p"].to_numpy(copy=True), pdf["size"].to_numpy(), seed)
        return pdf[["row", "src", "size", "p", "h", "salt"]]

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", draw_cols: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken, copies``.

    The draws depend on ``draw_cols`` (id and text) alone.  ``copies`` is how often the mix takes the document, ``taken`` the words of
    these copies.  Per source, ``sum(taken)`` comes within about one document of
    ``target``.
    """
    own = [F.col(id_col).cast("long").alias("mix_id"), F.col(source_col).cast("string").alias("mix_src")]
    sized = docs.select(*own, F.xxhash64(*(draw_cols or [id_col, text_col])).alias("h"), F.col(text_col).cast("string").alias("mix_text")).mapInArrow(
        _sizes, "mix_id long, mix_src string, h long, size long"
    )
    rows = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    # one row per source name
    per = rows.groupBy("mix_src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = add_targets(per).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.join(per.withColumnRenamed("mix_src", "per_src"), F.col("mix_src").eqNullSafe(F.col("per_src")))
    # rows that are equal many times over are told apart by place; else only by content, so a new layout changes nothing
    often = rows.groupBy("h").count().where(f"count > {BLOCK // 16}").select("h", F.lit(1).alias("many"))
    rows = rows.join(often, "h", "left").withColumn("salt", F.when(F.col("many") == 1, F.col("row")).otherwise(0))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rows = cut(rows)
    whole = rows.select("row", "mix_id", "size", "source_size", "target", "whole")
    # flight, level by level; src names a source without nulls
    state = rows.where(f"p > {EPS}").select("row", F.concat(F.when(F.col("mix_src").isNull(), "n").otherwise("s"), F.coalesce("mix_src", F.lit(""))).alias("src"), "size", "p", "h", "salt", F.col("n_docs").alias("left"))
    shape = "row long, src string, size long, p double, h long, salt long"
    decided, level = None, 0
    while True:
        most = state.agg(F.max("left")).first()[0] or 0
        last = most <= BLOCK
        block = F.pmod(F.xxhash64("h", "salt", F.lit(level)), F.ceil(F.col("left") / (BLOCK / 2)).cast("long"))
        block = F.when(F.col("left") <= BLOCK, F.lit(0).cast("long")).otherwise(block)
        moved = cut(state.withColumn("block", block).groupBy("src", "block").applyInPandas(_decide(last), shape))
        done = moved.where(f"p <= {EPS} or p >= {1 - EPS}").select("row", F.round("p").cast("int").alias("more"))
        decided = done if decided is None else decided.unionAll(done)
        if last:
            break
        state = moved.where(f"p > {EPS} and p < {1 - EPS}")
        state = state.join(state.groupBy("src").agg(F.count("*").alias("left")), "src")
        level += 1
    out = whole.join(decided, "row", "left").withColumn("copies", F.col("whole") + F.coalesce("more", F.lit(0)))
    return out.select(F.col("mix_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    ``docs`` is read twice and must give the same rows in the same places (a table does).
    """
    place = F.monotonically_increasing_id().alias("place")
    sized = docs.select(place, docs[id_col].alias("i"), docs[text_col].alias("t"), docs[source_col].alias("s"))
    copies = mix(sized, "place", "t", "s", ["i", "t"]).where("copies > 0").select("place", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return docs.select(F.struct(*docs.columns).alias("r"), place).join(copies, "place").select("r.*")
