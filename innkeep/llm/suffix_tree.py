"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its lower-cased words, each followed by a separator, and one end
symbol; the tree predicts each byte from the longest retained context, at most
``DEPTH`` bytes.  So unseen words have probabilities, and the tree is a model
of word sequences: the score is log10 of the probability of exactly these
words and the end.

* All ``DEPTH + 1``-grams of all texts, with their counts in the training texts,
  and the training words are gathered from every map task and summed by
  shuffles; shorter contexts are marginal sums.
* Every context is retained that occurs often enough and whose likelihood gained
  over its parent (count times Kullback-Leibler divergence) passes
  ``MIN_GAIN``, however many these are: the tree is a partitioned table.
* Distributions are interpolated with the parent's (Witten-Bell), the root's
  with half a count for each byte.  The tree is closed under suffixes and
  prefixes.
* A join a level carries the probabilities down the tree to every distinct
  ``DEPTH + 1``-gram.  Those of the most frequent ``FREQUENT_GRAMS`` go to every
  task; a text's other distinct n-grams go by a join, like its rare words.

``DEPTH``, the order of the model, is what a 64-bit key holds less one byte; it
doesn't follow the input.

Edge cases: null text is empty (one token, the end); rows without an id have a
null ``held_out`` and aren't learned from; repeated rows count each time; with
no training rows every count is 0 and the tree is a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytetext as bt
from .storage import cut, new_path, remove, written

DEPTH = 6
MIN_COUNT = 10
MIN_GAIN = 6.0
FREQUENT = 1 << 18  # words whose counts go to every task; the others' go by a join
FREQUENT_GRAMS = 1 << 21  # the same for n-grams and their probabilities
SEP, END = 0x20, 0x0A  # neither occurs in a word
CHUNK = 512


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document offsets in them, word hashes, word offsets); each document begins with ``DEPTH`` END symbols."""
    low = bt.lower(data)
    starts, ends, at = bt.runs(low, offsets, bt.NOT_SPACE)
    size = ends - starts
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # DEPTH + 1 END symbols a document, one SEP a word
    out_start = np.cumsum(size + 1) - (size + 1) + (DEPTH + 1) * doc + DEPTH
    total = int(size.sum()) + len(size) + (DEPTH + 1) * (len(at) - 1)
    seq = np.full(total, SEP, np.uint8)
    src = bt.ragged(starts, size)
    seq[src + np.repeat(out_start - starts, size)] = low[src]
    words = np.concatenate([[0], np.cumsum(size + 1)])
    doc_at = words[at] + (DEPTH + 1) * np.arange(len(at))
    pads = doc_at[:-1, None] + np.arange(DEPTH)
    seq[pads.reshape(-1)] = END
    seq[doc_at[1:] - 1] = END
    return seq, doc_at, bt.hash_runs(low, starts, ends), at


def _real(seq: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Which symbols are predicted: all but the leading END symbols."""
    real = np.ones(len(seq), bool)
    real[(doc_at[:-1, None] + np.arange(DEPTH)).reshape(-1)] = False
    return real


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _grams(seq: np.ndarray) -> np.ndarray:
    """For each symbol the number of it (lowest byte) and the ``DEPTH`` bytes before it."""
    keys = seq.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        keys[k:] |= seq[:-k].astype(np.uint64) << np.uint64(8 * k)
    return keys


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task in its training texts: ``kind`` 0 byte n-grams (those of other texts with 0), 1 words, 2 (key 0) documents."""
    held: dict[int, list] = {0: [], 1: []}
    docs = 0

    def summed(kind: int) -> Iterator[pa.RecordBatch]:
        if held[kind]:
            keys, counts = _merge(held[kind])
            held[kind] = []
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[i : i + 100_000])], names=["kind", "key", "c"]
                )

    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        docs += int(train.sum())
        for i, j, data, offsets in bt.text_slices(batch):
            seq, doc_at, words, at = sequence(data, offsets)
            real, learn = _real(seq, doc_at), np.repeat(train[i:j], np.diff(doc_at))
            keys = _grams(seq)
            other = np.unique(keys[real & ~learn])
            held[0].append((other, np.zeros(len(other), np.int64)))
            for kind, x in ((0, keys[real & learn]), (1, words[np.repeat(train[i:j], np.diff(at))])):
                held[kind].append(np.unique(x, return_counts=True))
                if len(held[kind]) >= 8:  # a few slices at once; Spark's map-side sum does the rest, and spills where it must
                    yield from summed(kind)
    for kind in held:
        yield from summed(kind)
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "c"])


class Tree:
    """The automaton: ``step[state, symbol]`` and ``logp[state, symbol]``; ``symbol`` maps bytes to columns."""

    def __init__(self, symbol: np.ndarray, step: np.ndarray, logp: np.ndarray):
        self.symbol, self.step, self.logp = symbol, step, logp

    def score(self, seq: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """log10 probability of each document of a symbol sequence."""
        if not len(seq):
            return np.zeros(len(doc_at) - 1)
        width = self.step.shape[1]
        rows = -(-len(seq) // CHUNK)
        s = np.full(DEPTH + rows * CHUNK, self.symbol[END], np.int32)
        s[DEPTH : DEPTH + len(seq)] = self.symbol[seq]
        out = np.empty((CHUNK, rows), np.float32)
        state = np.zeros(rows, np.int32)
        step, logp = self.step.reshape(-1), self.logp.reshape(-1)
        first = np.arange(rows) * CHUNK
        for k in range(DEPTH + CHUNK):
            at = state * width + s[first + k]
            if k >= DEPTH:
                out[k - DEPTH] = logp[at]
            state = step[at]
        each = out.T.reshape(-1)[: len(seq)].astype(np.float64)
        each[~_real(seq, doc_at)] = 0
        sums = np.concatenate([[0.0], np.cumsum(each)])
        return sums[doc_at[1:]] - sums[doc_at[:-1]]


def _keys(length: int, ctx):
    """One number for a context of ``length`` bytes."""
    return (ctx << 3) | length


def largest(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the greatest values of a positive column: all above a bound that at most ``most`` rows pass.

    The bound comes from a histogram of a few hundred classes of the value's
    logarithm, so no task or driver sorts or gathers the rows.
    """
    place = F.floor(F.log2(F.col(column).cast("double")) * 16)
    classes = sorted(((r.k, r["count"]) for r in df.groupBy(place.alias("k")).count().collect() if r.k is not None), reverse=True)
    total, bound = 0, None
    for k, n in classes:
        total += n
        if total > most:
            break
        bound = k
    if bound is None:  # the first class alone is larger: any of its rows
        return df.where(place == classes[0][0]).limit(most) if classes else df.limit(0)
    return df.where(place >= bound)


def _mask(length: int) -> int:
    return (1 << 8 * length) - 1


def levels(grams: DataFrame, keep=lambda df, k: cut(df)) -> list[DataFrame]:
    """For each context length the table ``key, c, n, w``: n-gram, its count, its context's count and number of different symbols."""
    out, level = [], grams.select("key", "c")
    for k in range(DEPTH, -1, -1):
        if k < DEPTH:
            level = level.groupBy(F.col("key").bitwiseAND(_mask(k + 1)).alias("key")).agg(F.sum("c").alias("c"))
        same = Window.partitionBy(F.shiftright("key", 8))
        level = keep(level.select("key", "c", F.sum("c").over(same).alias("n"), F.sum(F.expr("int(c > 0)")).over(same).alias("w")), k)
        out.append(level)
    return out[::-1]


def retained(tables: list[DataFrame]) -> list[DataFrame]:
    """For each context length the contexts ``ctx`` of the tree: all that pass the test, and their suffixes and prefixes."""
    out, longer = [], None
    for k in range(DEPTH, 0, -1):
        parent = tables[k - 1].select(F.col("key").alias("tail"), F.col("c").alias("pc"), F.col("n").alias("m"))
        own = tables[k].where(f"c > 0 and n >= {MIN_COUNT}").withColumn("tail", F.col("key").bitwiseAND(_mask(k)))
        gain = own.join(parent, "tail").groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum(F.expr("c * ln((c / n) / (pc / m))")).alias("gain"))
        kept = gain.where(f"gain >= {MIN_GAIN}").select("ctx")
        if longer is not None:
            kept = kept.unionAll(longer.select(F.explode(F.array(F.col("ctx").bitwiseAND(_mask(k)), F.shiftright("ctx", 8))).alias("ctx"))).distinct()
        longer = cut(kept)
        out.append(longer)
    return out[::-1]


def probabilities(tables: list[DataFrame], tree: list[DataFrame], keep=lambda df, k: cut(df)) -> DataFrame:
    """``key, c, logp``: log10 of the probability of each n-gram's symbol after the longest context of the tree before it."""
    p = tables[0].select("key", ((F.col("c") + 0.5) / (F.col("n") + 128)).alias("p"))
    for k in range(1, DEPTH + 1):
        own = tables[k].withColumn("tail", F.col("key").bitwiseAND(_mask(k))).withColumn("ctx", F.shiftright("key", 8))
        own = own.join(p.select(F.col("key").alias("tail"), F.col("p").alias("up")), "tail").join(tree[k - 1].withColumn("state", F.lit(True)), "ctx", "left")
        weight = F.greatest("w", F.lit(1))
        mixed = F.when(F.col("state"), (F.col("c") + weight * F.col("up")) / (F.col("n") + weight)).otherwise(F.col("up"))
        p = keep(own.select("key", "c", mixed.alias("p")), k)
    return p.select("key", "c", F.log10("p").alias("logp"))


def build(grams: DataFrame) -> Tree:
    """The whole tree as an automaton in this process, for ``(key, c)`` counts of few texts (symbol in the lowest byte, then the bytes before it)."""
    tables = levels(grams)
    states = {(0, 0)}
    for k, rows in enumerate(retained(tables), 1):
        states |= {(k, r.ctx) for r in rows.collect()}
    order = sorted(states)
    place = {s: i for i, s in enumerate(order)}
    spark = grams.sparkSession
    wanted = spark.createDataFrame([(k, v, i) for (k, v), i in place.items()], "k int, ctx long, state int")
    counts = None
    for k in range(DEPTH + 1):
        own = tables[k].where("c > 0").select(F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).cast("int").alias("sym"), "c")
        rows = own.join(wanted.where(f"k = {k}").drop("k"), "ctx").select("state", "sym", "c")
        counts = rows if counts is None else counts.unionAll(rows)
    counts = counts.toPandas()
    return _automaton(order, place, counts)


def _automaton(order: list, place: dict, counts: pd.DataFrame) -> Tree:
    used = np.unique(counts["sym"].to_numpy(np.int64))
    used = np.union1d(used, [SEP, END])
    symbol = np.full(256, len(used), np.int32)  # bytes that training never met share the last column
    symbol[used] = np.arange(len(used))
    width = len(used) + 1
    c = np.zeros((len(order), width))
    np.add.at(c, (counts["state"].to_numpy(np.int64), symbol[counts["sym"].to_numpy(np.int64)]), counts["c"].to_numpy(float))
    logp = np.empty((len(order), width), np.float32)
    p = np.empty((len(order), width))
    p[0] = (c[0] + 0.5) / (c[0].sum() + 128)
    lengths = np.array([k for k, _ in order])
    parent = np.array([place[(k - 1, v & ((1 << 8 * (k - 1)) - 1))] if k else 0 for k, v in order])
    for k in range(1, DEPTH + 1):
        at = np.flatnonzero(lengths == k)
        if len(at):
            weight = np.maximum((c[at] > 0).sum(1, keepdims=True), 1)
            p[at] = (c[at] + weight * p[parent[at]]) / (c[at].sum(1, keepdims=True) + weight)
    np.log10(p, out=p)
    logp[:] = p
    step = np.zeros((len(order), width), np.int32)
    keys = np.array([_keys(k, v) for k, v in order], np.int64)
    rank = np.argsort(keys)
    keys = keys[rank]
    values = np.array([v for _, v in order], np.int64)
    for col, byte in enumerate(used.tolist()):
        longer = (values << 8) | byte
        found = np.zeros(len(order), bool)
        for size in range(DEPTH, 0, -1):
            fits = ~found & (lengths + 1 >= size)
            want = _keys(size, longer[fits] & ((1 << 8 * size) - 1))
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[i] == want
            at = np.flatnonzero(fits)[hit]
            step[at, col] = rank[i[hit]]
            found[at] = True
    return Tree(symbol, step, logp)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


def _score(grams, top):
    kinds = {"row": pa.int64(), "id": pa.int64(), "n": pa.int64(), "known": pa.int64(), "gain": pa.float64(), "score": pa.float64(), "word": pa.int64(), "gram": pa.int64(), "m": pa.int64()}

    def rows_of(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, logp = grams.value
        keys, gains = top.value
        for batch in batches:
            for i, j, data, offsets in bt.text_slices(batch):
                m = j - i
                row = batch.column(0).slice(i, m).to_numpy(zero_copy_only=False)
                seq, doc_at, words, at = sequence(data, offsets)
                n = np.diff(at)
                doc = np.repeat(np.arange(m), n)
                k, known = _found(keys, words)
                gain = np.zeros(m)
                if known.any():
                    gain = np.bincount(doc[known], gains[k[known]], m)
                real = _real(seq, doc_at)
                owner = np.repeat(np.arange(m), np.diff(doc_at))[real]
                distinct, back = np.unique(_grams(seq)[real], return_inverse=True)
                g, near = _found(gram_keys, distinct)
                each = np.zeros(len(distinct))
                each[near] = logp[g[near]]
                score = np.bincount(owner, each[back], m)
                yield rows_of(m, row=row, id=batch.column(1).slice(i, m), n=n, known=np.bincount(doc[known], minlength=m).astype(np.int64), gain=gain, score=score)
                rare = words[~known]
                if len(rare):
                    yield rows_of(len(rare), row=row[doc[~known]], word=rare.view(np.int64))
                far = ~near[back]
                pairs, times = np.unique(owner[far] * len(distinct) + back[far], return_counts=True)
                if len(pairs):
                    yield rows_of(len(pairs), row=row[pairs // len(distinct)], gram=distinct[pairs % len(distinct)].view(np.int64), m=times)

    return run


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of a key and a number as two arrays in order of the unsigned key, by Arrow (no row objects)."""
    table = df.toArrow()
    keys = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column(1).to_numpy()[order].astype(float)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Training rows are those whose crc32 of the id's text, modulo ``folds``,
    isn't ``held``.  ``base_score`` is the smoothed unigram score of the same
    tokens.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    root = new_path(spark, "suffix-tree")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds == held
    counts = written(
        base.select("text", F.coalesce(~fold, F.lit(False)).alias("train")).mapInArrow(_gather, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c")),
        f"{root}/counts",
    )
    tables = levels(counts.where("kind = 0"), lambda df, k: written(df, f"{root}/level{k}"))
    grams = probabilities(tables, retained(tables), lambda df, k: written(df, f"{root}/mixed{k}"))
    words = counts.where("kind = 1").select("key", "c")
    total = counts.where("kind > 0").groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    n_docs = sum(r.c for r in total if r.kind == 2)
    n_all = n_docs + sum(r.c for r in total if r.kind == 1)
    distinct = sum(r.n for r in total if r.kind == 1) + (n_docs > 0)
    floor = n_all + 0.5 * (distinct + 1)
    # counts of the most frequent words: at most FREQUENT rows of 16 bytes
    keys, c = _sorted(largest(words, "c", FREQUENT))
    top = sc.broadcast((keys, np.log10((c + 0.5) / 0.5)))
    # probabilities of the most frequent n-grams: at most FREQUENT_GRAMS rows of 16 bytes
    near = sc.broadcast(_sorted(largest(grams, "c", FREQUENT_GRAMS).select("key", "logp")))
    rows = base.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    scored = written(
        rows.mapInArrow(_score(near, top), "row long, id long, n long, known long, gain double, score double, word long, gram long, m long"), f"{root}/scored"
    )
    rare = (
        scored.where("word is not null").select("row", F.col("word").alias("key")).join(words, "key")
        .groupBy("row").agg(F.count("*").alias("rare"), F.sum(F.log10((F.col("c") + 0.5) / 0.5)).alias("rare_gain"))
    )
    far = (
        scored.where("gram is not null").select("row", F.col("gram").alias("key"), "m").join(grams.select("key", "logp"), "key")
        .groupBy("row").agg(F.sum(F.col("m") * F.col("logp")).alias("far"))
    )
    unseen = float(np.log10(0.5 / floor))
    end = float(np.log10((n_docs + 0.5) / floor))
    out = scored.where("n is not null").join(rare, "row", "left").join(far, "row", "left").select(
        F.col("id").alias(id_col),
        (F.crc32(F.col("id").cast("string").cast("binary")) % folds == held).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rare", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("n") * F.lit(unseen) + F.col("gain") + F.coalesce("rare_gain", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )
    out = cut(out)
    remove(spark, root)
    return out
