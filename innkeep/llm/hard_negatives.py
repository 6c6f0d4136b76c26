"""Hard-negative mining on Strassen products of anchor and candidate tiles.

Anchors and candidates are dealt into blocks of bounded size; a task holds one
block of each, and computes their integer inner products tile by tile with
Strassen's recursion: tiles are halved in all three dimensions (padded with a
zero row or column where odd), seven products of half-size tiles replace eight,
and all additions are int64 additions, exact.

Pass 1 multiplies anchors with candidates of their own label: each tile gives a
heap of the best positives of every anchor, and heaps are merged by score, then
id.  Pass 2 multiplies the anchors that have positives with all candidates:
each tile gives, per anchor and positive, a heap of the best rows of other
labels whose score lies in the positive's window, merged likewise.  Heaps have
a fixed size, and labels are cut into blocks, so a label or id that holds a
third of all rows is many tasks.

Components are floor(scale * x), x as double.  Scores are exact: rows with a
component beyond ``limit(length)``, whose products could leave the range of a
long (of 64 components: about 185,000 before scaling), take no part.

Edge cases: rows without an id or label, with a null or empty vector, with null
or non-finite components, or of another length than most take no part; each
row is an anchor and a candidate of its own, also where ids repeat; an anchor
without positives, or a positive without rows in its window, gives no rows; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import checked, cut

LEAF = 16  # tiles with a side up to here are multiplied directly
TILE = 512  # anchors of a product
ANCHORS = 4096  # anchors per block
CANDIDATES = 4096  # candidates per block
LOWEST = np.iinfo(np.int64).min


def limit(length: int) -> int:
    """Largest magnitude of a component: ``length`` products of two, times 100, fit a long."""
    return isqrt((1 << 56) // length)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices."""
    rows, inner = a.shape
    cols = b.shape[1]
    if min(rows, inner, cols) <= leaf:
        return a @ b
    r, m, c = -(-rows // 2), -(-inner // 2), -(-cols // 2)
    if rows % 2 or inner % 2:
        a = np.pad(a, ((0, 2 * r - rows), (0, 2 * m - inner)))
    if inner % 2 or cols % 2:
        b = np.pad(b, ((0, 2 * m - inner), (0, 2 * c - cols)))
    a11, a12, a21, a22 = a[:r, :m], a[:r, m:], a[r:, :m], a[r:, m:]
    b11, b12, b21, b22 = b[:m, :c], b[:m, c:], b[m:, :c], b[m:, c:]
    out = np.zeros((2 * r, 2 * c), np.int64)
    c11, c12, c21, c22 = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11 += p
    c22 += p
    p = strassen(a21 + a22, b11, leaf)
    c21 += p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12 += p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :cols]


def _integers(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _candidates(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Candidate vectors as columns, by id: the first of equal scores is the smaller id."""
    table = table.sort_by([("id", "ascending"), ("row", "ascending")])
    return np.ascontiguousarray(_integers(table.column("v")).T), table


def _peaks(scores: np.ndarray, count: int):
    """Per round, the column of each row's best score and that score; ``scores`` is used up."""
    each = np.arange(len(scores))
    for _ in range(min(count, scores.shape[1])):
        at = scores.argmax(1)
        best = scores[each, at]
        yield at, best
        scores[each, at] = LOWEST


POSITIVE = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
NEGATIVE = pa.schema([("anchor", pa.int64()), ("k", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _table(parts: list[list[np.ndarray]], schema: pa.Schema) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _positive_heaps(count: int):
    """Best ``count`` other rows of each anchor within one tile of its label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            b, right = _candidates(right)
            rows, ids = _numbers(right, "row"), _numbers(right, "id")
            for i in range(0, left.num_rows, TILE):
                part = left.slice(i, TILE)
                own = _numbers(part, "row")
                s = strassen(_integers(part.column("v")), b)
                s[own[:, None] == rows[None, :]] = LOWEST
                for at, best in _peaks(s, count):
                    hit = best > LOWEST
                    parts.append([own[hit], rows[at[hit]], ids[at[hit]], best[hit]])
        return _table(parts, POSITIVE)

    return run


def _window_heaps(count: int):
    """Best ``count`` rows of other labels within each window of each anchor, in one tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            b, right = _candidates(right)
            rows, ids, labels = _numbers(right, "row"), _numbers(right, "id"), _numbers(right, "label")
            for i in range(0, left.num_rows, TILE):
                part = left.slice(i, TILE)
                own = _numbers(part, "row")
                s = strassen(_integers(part.column("v")), b)
                s[_numbers(part, "label")[:, None] == labels[None, :]] = LOWEST
                lows, highs = part.column("low").combine_chunks(), part.column("high").combine_chunks()
                sizes = np.diff(lows.offsets.to_numpy())
                low, high = lows.flatten().to_numpy(), highs.flatten().to_numpy()
                start = np.cumsum(sizes) - sizes
                for k in range(int(sizes.max())):
                    has = np.flatnonzero(sizes > k)
                    lo, hi = low[start[has] + k][:, None], high[start[has] + k][:, None]
                    window = s[has]
                    window[(window < lo) | (window > hi)] = LOWEST
                    for at, best in _peaks(window, count):
                        hit = best > LOWEST
                        parts.append([own[has[hit]], np.full(int(hit.sum()), k), rows[at[hit]], ids[at[hit]], best[hit]])
        return _table(parts, NEGATIVE)

    return run


def _merged(heaps: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The best ``count`` of the heaps of each key, numbered from 1 (tasks keep ``count`` of a key before the shuffle)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``window`` gives the least and greatest score of a negative, as a
    percentage of the positive's.
    """
    x = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), x.alias("x"), is_anchor.alias("asked"))
    rows = rows.where("id is not null and label is not null and x is not null and size(x) > 0")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = rows.groupBy(F.size("x").alias("m")).count().orderBy(F.desc("count"), "m").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    size, most = common["m"], limit(common["m"])
    rows = rows.where(F.size("x") == size).withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("double")))
    rows = rows.where(F.forall("x", lambda c: F.abs(c) <= most))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.col("x").cast("array<int>").alias("v"), F.coalesce("asked", F.lit(False)).alias("asked")))

    def blocks(n: Column, most: int) -> Column:
        return F.ceil(n / most).cast("int")

    def dealt(count: Column | str) -> Column:
        return F.pmod(F.xxhash64("row"), count).cast("int")

    def every(count: Column | str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def paired(left: DataFrame, right: DataFrame, keys: list[str]):
        """Blocks that meet in a task; new column identities keep the two sides of one table apart."""
        return left.toDF(*left.columns).groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys))

    # pass 1: tiles within a label
    sizes = rows.groupBy("label").agg(blocks(F.count_if("asked"), ANCHORS).alias("parts"), blocks(F.count("*"), CANDIDATES).alias("pieces")).where("parts > 0")
    shaped = rows.join(checked(cut(sizes)), "label")
    keys = ["label", "part", "piece"]
    left = shaped.where("asked").select("row", "v", "label", dealt(F.col("parts")).alias("part"), every("pieces").alias("piece"))
    right = shaped.select("row", "id", "v", "label", dealt(F.col("pieces")).alias("piece"), every("parts").alias("part"))
    heaps = paired(left, right, keys).applyInArrow(_positive_heaps(positives), "anchor long, row long, id long, score long")
    best = cut(_merged(heaps, ["anchor"], positives))

    # pass 2: windows against all rows
    low, high = window
    pairs = best.select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place"),
        F.ceil(F.col("score") * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("low"),
        F.floor(F.col("score") * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("high"),
    )
    windows = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high", "positive_id", "positive_score"))).alias("w"))
    counts = rows.agg(blocks(F.count("*"), CANDIDATES).alias("pieces"), blocks(F.count_if("asked"), ANCHORS).alias("parts")).first()
    pieces, parts = max(1, counts["pieces"]), max(1, counts["parts"])
    asked = cut(rows.where("asked").join(windows, F.col("row") == F.col("anchor")).drop("anchor"))
    keys = ["part", "piece"]
    left = asked.select("row", "v", "label", F.col("w.low").alias("low"), F.col("w.high").alias("high"), dealt(F.lit(parts)).alias("part"), F.lit(pieces).alias("pieces"))
    left = left.select("row", "v", "label", "low", "high", "part", every("pieces").alias("piece"))
    right = rows.select("row", "id", "v", "label", dealt(F.lit(pieces)).alias("piece"), F.lit(parts).alias("parts"))
    right = right.select("row", "id", "v", "label", "piece", every("parts").alias("part"))
    heaps = paired(left, right, keys).applyInArrow(_window_heaps(negatives), "anchor long, k int, row long, id long, score long")
    found = _merged(heaps, ["anchor", "k"], negatives).select("anchor", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "w")
    return found.join(of, "anchor").select(
        "anchor_id", F.expr("w[k].positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.expr("w[k].positive_score").alias("positive_score"), "negative_score"
    )
