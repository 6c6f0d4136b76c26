"""Exact top-k inner-product search with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the vectors
of a pivot, in order of distance, form annuli (rings) of equal width.  For a
query q and a ring around pivot p, the triangle inequality bounds every
distance in the ring from below by the gap between d(q, p) and the ring, and

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2

bounds the ring's scores from above.  A query expands its rings in order of
that bound: first the best ones until they hold enough vectors for k, which
gives a k-th score, then every ring whose bound reaches that score.  All other
rings are proven to hold nothing.  Rings and query lists are cut into blocks
of bounded size, so a ring that holds a third of all rows is many tasks.  Queries
of neighbouring pivots share a list, and a block of a ring goes to those lists
alone in which a query visits the ring; the number of pivots grows with the root
of the table.

Components are floor(scale * x), scores are integers and exact: vectors with a
component above sqrt(2**52 / length) (of 64 components: about 131,000 before
scaling), whose scores could be inexact, take no part.  Ties go to the smaller id.

Edge cases: vectors that are null, hold null or non-finite components, or have
another length than most take no part; neither do rows without an id; repeated
rows are candidates of their own (a query leaves out rows with its own id), and
rows of one id with different vectors are queries of their own;
fewer than k candidates are all returned; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import cut

PIVOTS = 32  # at least
PIVOT_SHARE = 16  # one pivot for so many in the root of the number of vectors
MOST_PIVOTS = 1024
PIVOT_SAMPLE = 4096  # vectors, on average, that the pivots are chosen from
RINGS = 8
BLOCK = 4096  # vectors of a ring, and queries, per task group
CELLS = 1 << 20  # bounds of queries and rings computed at once
EXACT = 1 << 52  # scores are below this


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, v``: integer vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), F.sqrt(F.lit(float(EXACT)) / F.size("x")).alias("most"))
    # products of larger components would not be exact
    return rows.where(F.forall("v", lambda c: F.abs(c.cast("double")) <= F.col("most"))).select("id", F.col("v").cast("array<long>").alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first vectors of a sample: well spread, and no two equal."""
    if not len(sample):
        return sample
    picked = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and d.max() > 0:
        k = int(d.argmax())
        picked.append(k)
        d = np.minimum(d, ((sample - sample[k]) ** 2).sum(1))
    return sample[picked]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0))  # integers: sq is exact


def _key(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                d = _distances(x, p)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array((x**2).sum(1))],
                    names=["id", "v", "pivot", "dist", "norm"],
                )

    return run


def _visits(pivots, rings, far: bool):
    """The rings that each query visits: those it needs for k candidates, or (``far``) the others whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        r = rings.value
        step = max(1, CELLS // max(1, len(r["ring"])))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                q = _matrix(part.column(2))
                d = _distances(q, p)[:, r["pivot"]]
                gap = np.maximum(0, np.maximum(d - r["hi"], r["lo"] - d))
                top = ((q**2).sum(1)[:, None] + r["norm"] - gap**2) / 2 + 1e-6 * (1 + r["norm"])
                order = np.argsort(-top, 1, kind="stable")
                filled = np.cumsum(r["n"][order], 1)
                first = np.empty_like(order)
                np.put_along_axis(first, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
                # rings before this place in the order hold fewer than k others
                before = np.concatenate([np.zeros((len(order), 1)), filled[:, :-1]], 1)
                go = np.take_along_axis(before, first, 1) < r["k"] + 1
                if far:
                    go = ~go & (top >= part.column(4).to_numpy()[:, None])
                places = np.nonzero(go)[1].astype(np.int32)
                at = np.concatenate([[0], np.cumsum(go.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, places)], names=["asked", "query_id", "q", "part", "floor", "places"])

    return run


def _best(k: int):
    """Top k per query within one block of a ring and one block of queries."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"asked": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            x = np.stack(right["v"].to_numpy()).astype(np.float64)
            ids = right["id"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for i in range(0, len(left), 256):
                part = left.iloc[i : i + 256]
                scores = np.stack(part["q"].to_numpy()).astype(np.float64) @ x.T
                for asked, qid, floor, s in zip(part["asked"], part["query_id"], part["floor"], scores):
                    s = np.where(ids == qid, -np.inf, s)
                    m = min(k, len(s))
                    low = np.partition(s, len(s) - m)[len(s) - m]
                    hit = np.flatnonzero(s >= max(low, floor))
                    hit = hit[np.isfinite(s[hit])]
                    hit = hit[np.argsort(-s[hit], kind="stable")][:k]  # ids ascend among equals
                    out["asked"].append(np.full(len(hit), asked))
                    out["query_id"].append(np.full(len(hit), qid))
                    out["vec_id"].append(ids[hit])
                    out["score"].append(s[hit].astype(np.int64))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query vector (rows of ``queries``)."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = integers(vectors, id_col, vec_col, scale)
    sizes = rows.groupBy(F.size("v").alias("m")).count().orderBy(F.desc("count"), "m").first()
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes["m"])
    # pivots: from a bounded sample, by a hash of the id; they decide cost only
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(sizes["count"]) // PIVOT_SHARE))
    share = int(min(1.0, PIVOT_SAMPLE / sizes["count"]) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).limit(2 * PIVOT_SAMPLE).toPandas().sort_values("id")["v"]
    if not len(sample):
        sample = rows.limit(1).toPandas()["v"]
    p = sc.broadcast(choose_pivots(np.stack(sample.to_numpy()).astype(np.float64), pivots))
    keyed = cut(rows.mapInArrow(_key(p), "id long, v array<long>, pivot int, dist double, norm double"))
    # at most MOST_PIVOTS * RINGS rings
    ends = keyed.groupBy("pivot").agg(F.min("dist").alias("d0"), F.max("dist").alias("d1"))
    ring = F.least(F.lit(RINGS - 1), F.floor((F.col("dist") - F.col("d0")) / F.greatest(F.col("d1") - F.col("d0"), F.lit(1e-9)) * RINGS)).cast("int")
    index = keyed.join(ends, "pivot").withColumn("ring", F.col("pivot") * RINGS + ring).select("id", "v", "pivot", "ring", "dist", "norm")
    rings = index.groupBy("ring", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("ring").toPandas()
    facts = {c: rings[c].to_numpy(np.float64) for c in ("lo", "hi", "norm")} | {c: rings[c].to_numpy(np.int64) for c in ("pivot", "ring", "n")} | {"k": k}
    places = spark.createDataFrame(
        [(int(r), int(-(-n // BLOCK)), j) for j, (r, n) in enumerate(zip(facts["ring"], facts["n"]))], "ring int, blocks int, place int"
    )
    index = index.join(F.broadcast(places), "ring").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "v", "place", "block")
    asked = queries.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    # rows of one id with different vectors are queries of their own
    low = float(-(2**62))
    wanted = keyed.join(asked, "id", "left_semi").dropDuplicates(["id", "v"]).select("id", "v", "pivot")
    wanted = cut(wanted.select(F.monotonically_increasing_id().alias("asked"), F.col("id").alias("query_id"), F.col("v").alias("q"), "pivot"))
    # lists of about BLOCK queries, in order of their pivot (at most MOST_PIVOTS counts)
    homes = wanted.groupBy("pivot").agg(F.count("*").alias("n")).orderBy("pivot").toPandas()
    homes = [(int(v), int(n), int(e - n)) for v, n, e in zip(homes["pivot"], homes["n"], homes["n"].cumsum())]
    homes = F.broadcast(spark.createDataFrame(homes, "pivot int, n long, before long"))
    part = F.floor((F.col("before") + F.pmod(F.xxhash64("asked"), F.col("n"))) / BLOCK).cast("int").alias("part")
    wanted = wanted.join(homes, "pivot").select("asked", "query_id", "q", part)
    facts = sc.broadcast(facts)

    def search(queries: DataFrame, far: bool) -> DataFrame:
        """Each query's best within the rings it visits: ``queries(asked, query_id, q, part, floor)``."""
        visits = cut(queries.mapInArrow(_visits(p, facts, far), "asked long, query_id long, q array<long>, part int, floor double, places array<int>"))
        keys = ["place", "block", "part"]
        # the lists in which a ring is visited
        lists = visits.select(F.col("part").alias("list"), F.explode("places").alias("place")).distinct()
        lists = lists.join(F.broadcast(places), "place").select("place", F.col("list").alias("part"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        data = index.join(lists, ["place", "block"])
        visits = visits.withColumn("place", F.explode("places")).drop("places").join(F.broadcast(places.select("place", "blocks")), "place")
        visits = visits.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        return visits.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_best(k), "asked long, query_id long, vec_id long, score long")

    near = cut(search(wanted.withColumn("floor", F.lit(low)), False))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("r", F.row_number().over(order)).where(f"r = {k}").select("asked", F.col("score").cast("double").alias("kth"))
    far = search(wanted.join(kth, "asked", "left").select("asked", "query_id", "q", "part", F.coalesce("kth", F.lit(low)).alias("floor")), True)
    best = near.unionAll(far).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
