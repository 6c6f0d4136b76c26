"""N-gram Jaccard join with adaptive multi-match prefixes.

Each text is the set of its distinct k-word shingles (64-bit hashes; ASCII
letters lower-cased).  Under one global order (rarer shingles first) two sets
with overlap >= t share at least l elements of their l-prefixes, the first
``size - t + l`` elements.  A longer prefix therefore asks for more shared
elements before a pair is verified.  Every document picks its own l from the
lengths of the lists its prefix would read and the verifications they imply.

Plan, in Spark jobs:

1. one pass over the texts writes a 128-bit set key per row and a fixed-size
   table of shingle frequencies (2**20 buckets; it only sets the order, every
   order is exact);
2. a second pass emits prefix postings ``(token, set, n, pos)``; tokens that
   only one set holds are dropped, and repeated sets meet in the first row that
   holds them, whose number names the set from here on;
3. every set is verified against leaders: the member without tokens of its
   own that it meets in most lists, then the members drawn for its lists, one
   a size class.  Linked sets form components, so a group of n near copies costs
   a multiple of n verifications here, not n * n.  A drawn member has met all
   others of its list that its size lets it link to, so it leaves that list: a
   list of two is settled in one round;
4. pairs *between* components are generated from what is left of the postings
   with the size, position and multi-match filters and verified on their whole
   sets.  Pairs within a component can't change the answer.  In both steps sets
   carry 256 parity bits: they differ in at least as many shingles as these
   differ in bits.  What these leave is compared by a longer sketch of that
   kind, two to four bits a shingle, which rules out nearly all other pairs
   before whole sets are moved;
5. connected components: each round joins the components its links connect.

Edge cases: null or empty text gives an empty set, linked with nothing; a
row without an id returns a null component; rows that share an id are
documents of their own with the same id; equal sets always link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytetext as bt
from .graph import components
from .storage import checked, cut, new_path, remove, written

BUCKET_BITS = 20  # size of the frequency table: 4 MiB, whatever the corpus
CHUNK = 1 << 14
FILTER_BITS = 26
MAX_MATCH = 3  # longest prefix asks for so many shared tokens
VERIFY_COST = 50.0  # of one verification, in posting reads

_MULT = bt.mix(np.arange(1, 64, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their offsets."""
    starts, ends, at = bt.runs(data, offsets, bt.NOT_SPACE)
    h = bt.hash_runs(bt.lower(data), starts, ends)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    parts, owners = [], []
    if len(h) >= words:
        last = len(h) - words + 1
        s = np.zeros(last, np.uint64)
        for k in range(words):
            s += h[k : k + last] * _MULT[k]
        inside = doc[:last] == doc[words - 1 :]
        parts.append(s[inside])
        owners.append(doc[:last][inside])
    short = (n > 0) & (n < words)
    if short.any():
        take = short[doc]
        place = np.arange(len(h)) - at[:-1][doc]
        value = h[take] * _MULT[place[take]]
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, doc[take], value)
        parts.append(total[short] + n[short].astype(np.uint64))
        owners.append(np.flatnonzero(short))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    s, d = bt.mix(np.concatenate(parts)), np.concatenate(owners)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(n) + 1))


def set_keys(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128-bit key of each set (empty sets share one)."""
    halves = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bt.mix(s ^ np.uint64(salt)))])
        halves.append(bt.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    both = np.stack(halves, 1).astype(">u8").tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


DRAWS = 6  # rounds of drawn leaders at most; pairs left over are found one by one
DRAW_PAYS = 20  # another round, if one set in so many was linked ...
LEFT_PAYS = 16  # ... or one in so many of the first postings still shares a list
SKETCH_BITS = 1 << 16  # longest sketch (8 KiB); shorter sets have two to four bits a shingle

SIGNS = ["s0", "s1", "s2", "s3"]


def signatures(s: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """256 parity bits of each set, as four columns of 64."""
    place = bt.mix(s ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(56)
    bit = np.uint64(1) << (place & np.uint64(63))
    out = []
    for k in range(4):
        sums = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint64), np.where(place >> np.uint64(6) == k, bit, np.uint64(0))]))
        out.append((sums[at[1:]] ^ sums[at[:-1]]).view(np.int64))
    return out


def sketches(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bits of each set, a power of two of them; the XOR of a sketch's halves is the sketch of half the length."""
    n = np.diff(at)
    bits = np.minimum(1 << np.ceil(np.log2(np.maximum(2 * n, 256))).astype(np.int64), SKETCH_BITS)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(bits)])
    doc = np.repeat(np.arange(len(n)), n)
    place = bt.mix(s ^ np.uint64(0xA0761D6478BD642F)).view(np.int64) & (bits[doc] - 1)
    odd = np.bincount(first[doc] + place, minlength=first[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[i:j] for i, j in zip(first[:-1] >> 3, first[1:] >> 3)]


def _apart(x: bytes, y: bytes) -> int:
    """Places where two sketches differ, at the length of the shorter one."""
    x, y = (np.frombuffer(z, np.uint64) for z in (x, y))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            room = total - 2 * -(-num * total // (num + den))
            apart = [_apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5))]
            mask = pa.array(np.array(apart, np.int64) <= room)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    return run


def _may_link(num: int, den: int, x: str, y: str) -> str:
    """SQL: the signatures of two sets leave room for the overlap (columns n and s0 to s3, with these endings)."""
    apart = " + ".join(f"bit_count({c}{x} ^ {c}{y})" for c in SIGNS)
    return f"{apart} <= n{x} + n{y} - 2 * ceil({num} * (n{x} + n{y}) / {num + den})"


def _summaries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        shift = np.uint64(64 - BUCKET_BITS)
        for batch in batches:
            for i, j, data, offsets in bt.text_slices(batch):
                s, at = shingle_sets(data, offsets, words)
                counts += np.bincount((s >> shift).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.diff(at), pa.int32()), pa.array(set_keys(s, at), pa.binary()), *map(pa.array, signatures(s, at)), pa.array(sketches(s, at), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["row", "id", "n", "sid", *SIGNS, "sketch", "chunk", "counts"],
                )
        chunks = [k for k in range(0, len(counts), CHUNK) if counts[k : k + CHUNK].any()]
        m = len(chunks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.binary()), pa.array([k // CHUNK for k in chunks], pa.int32()), pa.array([counts[k : k + CHUNK].tobytes() for k in chunks], pa.binary())],
            names=["row", "id", "n", "sid", *SIGNS, "sketch", "chunk", "counts"],
        )

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(c, np.uint32).astype(np.uint64)
            total[k] = total[k] + c if k in total else c
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"]
    )


def frequency_table(summaries: DataFrame) -> np.ndarray:
    """Shingle counts by bucket over all documents: 2**20 numbers."""
    rows = (
        summaries.where("chunk is not null").select("chunk", "counts")
        .repartition("chunk")
        .mapInArrow(_sum_chunks, "chunk int, counts binary")
        .collect()  # 64 rows of 128 KiB at most
    )
    out = np.zeros(1 << BUCKET_BITS, np.uint64)
    for r in rows:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.uint64)
    # ranks keep the order in 4 bytes
    return np.unique(out, return_inverse=True)[1].astype(np.uint32)


def _postings(words: int, num: int, den: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        shift = np.uint64(64 - BUCKET_BITS)
        for batch in batches:
            seen: set[bytes] = set()
            for _, _, data, offsets in bt.text_slices(batch):
                s, at = shingle_sets(data, offsets, words)
                keys, n = set_keys(s, at), np.diff(at)
                fresh = np.zeros(len(n), bool)
                for k, key in enumerate(keys):
                    if n[k] and key not in seen:
                        seen.add(key)
                        fresh[k] = True
                d = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((s, rank[(s >> shift).astype(np.int64)], d))
                s = s[order]
                pos = np.arange(len(s)) - at[:-1][d]
                most = n - -(-num * n // den) + MAX_MATCH  # the longest prefix
                take = fresh[d] & (pos < most[d])
                d = d[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[take].view(np.int64)), pa.array(keys, pa.binary()).take(pa.array(d)), pa.array(n[d], pa.int32()), pa.array(pos[take], pa.int32())],
                    names=["token", "sid", "n", "pos"],
                )

    return run


def id_hash(column: str) -> Column:
    """The place of an id in :func:`id_filter`."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bit table of 2**FILTER_BITS hashed ids: 8 MiB, whatever their number (more ids only make it less selective)."""
    h = id_hash(ids.columns[0])
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def _whole_sets(words: int, filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False)
            roles = [(t[h >> 6] >> (h & 63)) & 1 == 1 for t in filters.value]
            wanted = np.flatnonzero(roles[0] | roles[1])
            batch = batch.take(pa.array(wanted))
            roles = [pa.array(r[wanted]) for r in roles]
            for i, j, data, offsets in bt.text_slices(batch):
                s, at = shingle_sets(data, offsets, words)
                values = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(s)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(set_keys(s, at), pa.binary()), values, *[r.slice(i, j - i) for r in roles]], names=["id", "sid", "toks", "as_a", "as_b"]
                )

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = []
            for x, y in zip(ta, tb):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id`` (smallest linked id).

    Two rows link when ``den * intersection >= num * union``, both sets
    being non-empty.  See the module text for edge cases.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    root = new_path(spark, "ngram-join")

    # 1. set keys and frequencies
    summary = written(
        base.mapInArrow(_summaries(words), f"row long, id long, n int, sid binary, {', '.join(f'{c} long' for c in SIGNS)}, sketch binary, chunk int, counts binary"), f"{root}/summary"
    )
    ranks = sc.broadcast(frequency_table(summary))
    rows = summary.where("chunk is null").select("row", "id", "n", "sid")
    held = summary.where("chunk is null and n > 0 and id is not null")
    reps = written(held.groupBy("sid").agg(F.min("row").alias("node"), F.min("id").alias("id"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in SIGNS]), f"{root}/sets")
    sketch = summary.where("chunk is null and n > 0 and id is not null").select("row", "sketch")

    # 2. postings of the prefixes; tokens of one set only can't link
    posts = written(
        base.where("id is not null").select("text").mapInArrow(_postings(words, num, den, ranks), "token long, sid binary, n int, pos int"),
        f"{root}/postings",
    )
    short = posts.select("token", F.xxhash64("sid").alias("h"))
    shared = short.groupBy("token").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("token")
    # copies of a set come from several tasks; they meet by set, so a frequent token is spread
    names = reps.select("sid", "node")
    posts = written(posts.join(shared, "token").join(names, "sid").select("sid", "token", "node", "n", "pos").distinct().drop("sid"), f"{root}/shared")
    remove(spark, f"{root}/postings")
    # levels: the first l for which the posting is in the l-prefix, as the longer and as the shorter set of a pair
    posts = posts.withColumn("probe", F.expr(f"greatest(1, pos + 2 - (n - ceil({num} * n / {den}) + 1))").cast("int")).withColumn(
        "index", F.expr(f"greatest(1, pos + 2 - (n - ceil({2 * num} * n / {num + den}) + 1))").cast("int")
    )

    # each set's l: reads of its l-prefix plus the verifications they imply
    levels = range(1, MAX_MATCH + 1)
    lists = posts.groupBy("token").agg(*[F.count_if(F.col("index") <= k).alias(f"d{k}") for k in levels])
    costs = posts.join(lists, "token").groupBy("node").agg(
        F.min("n").alias("n"),
        F.min("pos").alias("first"),
        *[F.sum(F.when(F.col("probe") <= k, F.col(f"d{k}")).otherwise(0)).alias(f"c{k}") for k in levels],
    )
    estimate = [F.col(f"c{k}") * (1 + VERIFY_COST / k) for k in levels]
    best = F.least(*estimate)
    need = F.lit(1)
    for k in reversed(levels):
        need = F.when(estimate[k - 1] <= best, F.lit(k)).otherwise(need)
    # sets of a few shingles don't have so many to share
    choice = written(costs.select("node", "first", F.when(F.col("n") < 4 * MAX_MATCH, 1).otherwise(need).alias("need")), f"{root}/choice")
    posts = written(posts.join(checked(choice), "node"), f"{root}/chosen")
    remove(spark, f"{root}/shared")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (reps.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", *SIGNS)]).withColumnRenamed(f"node_{k}", k) for k in "ab")
        # a short list of pairs (counted) goes to the sets, a longer one meets them by a shuffle
        met = written(pairs, f"{root}/{name}-met")
        near = written(a.join(checked(met), "a").join(b, "b").where(_may_link(num, den, "_a", "_b")).select("a", "b", "n_a", "n_b"), f"{root}/{name}-near")
        of_b = sketch.toDF("b", "kb").join(checked(near.select("b").distinct()), "b", "left_semi")
        near = sketch.toDF("a", "ka").join(checked(near), "a").join(of_b, "b").select("a", "b", "n_a", "n_b", "ka", "kb")
        near = written(near.mapInArrow(_near(num, den), "a long, b long"), f"{root}/{name}-nearer")
        a, b = (reps.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "id", "sid")]).withColumnRenamed(f"node_{k}", k) for k in "ab")
        pairs = written(a.join(checked(near), "a"), f"{root}/{name}-a")
        pairs = written(b.join(checked(pairs), "b"), f"{root}/{name}-pairs")
        filters = sc.broadcast([id_filter(pairs.select(c)) for c in ("id_a", "id_b")])
        sets = written(
            base.where("id is not null").select("id", id_hash("id").alias("h"), "text").mapInArrow(_whole_sets(words, filters), "id long, sid binary, toks binary, as_a boolean, as_b boolean"),
            f"{root}/{name}-sets",
        )
        ta = sets.where("as_a").select(F.col("id").alias("id_a"), F.col("sid").alias("sid_a"), F.col("toks").alias("ta"))
        tb = sets.where("as_b").select(F.col("id").alias("id_b"), F.col("sid").alias("sid_b"), F.col("toks").alias("tb"))
        whole = ta.join(checked(pairs), ["id_a", "sid_a"]).select("a", "ta", "b", "id_b", "sid_b")
        whole = whole.join(tb, ["id_b", "sid_b"]).select("a", "b", "ta", "tb")
        out = written(whole.mapInArrow(_verify(num, den), "a long, b long"), f"{root}/{name}-links")
        remove(spark, f"{root}/{name}-sets")
        return out

    # 3. leaders, in a few rounds; what links to one is joined for a cost linear in the postings.
    # First every set and the set with the fewest tokens of its own in its lists (by size class) ...
    # (a hair wider than the sizes of linked sets may be apart, so that rounding can't put these two bands apart)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) * (1 - 1e-9)).alias("band")
    banded = posts.select("token", "node", "n", "pos", "first", band)
    leaders = banded.groupBy("token", "band").agg(F.min(F.struct("first", "node", "n")).alias("lead"))
    met = (
        banded.join(leaders, ["token", "band"])
        .where(f"node != lead.node and {den} * least(n, lead.n) >= {num} * greatest(n, lead.n)")
        .groupBy("node", "n", F.col("lead.node").alias("b"), F.col("lead.n").alias("nb")).agg(F.count("*").alias("c"), F.min("pos").alias("p"))
        .where(f"n - p >= ceil({num} * (n + nb) / {num + den})")  # no room for the overlap: left to step 4
    )
    first_pairs = met.groupBy("node").agg(F.max(F.struct("c", "b")).alias("m")).select(F.col("node").alias("a"), F.col("m.b").alias("b"))

    def merged(groups: DataFrame, found: DataFrame) -> DataFrame:
        """``groups`` (linked sets and their components) with the components joined that ``found`` connects."""
        if found.isEmpty():
            return groups
        ends = found.join(groups.toDF("a", "comp_a"), "a", "left").join(groups.toDF("b", "comp_b"), "b", "left")
        moved = components(ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))).toDF("comp", "to")
        old = groups.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        return cut(old.unionAll(moved.toDF("node", "comp").join(groups, "node", "left_anti")))

    groups = merged(spark.createDataFrame([], "node long, comp long"), links(first_pairs, "leader"))

    # ... then every set and, in each list that holds several components, those drawn for the list, one a band, now and
    # again.  A drawn set has met all of the list that it may link to (sizes of linked sets are at most a band apart)
    # and leaves it
    def placed(posts: DataFrame, groups: DataFrame) -> DataFrame:
        return posts.join(checked(groups), "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    overlap = f"ceil({num} * (n + l.n) / {num + den})"
    may_meet = (
        f"comp != l.comp and abs(band - l.band) <= 1 and {den} * least(n, l.n) >= {num} * greatest(n, l.n)"
        f" and least(pos, l.pos) + least(n - pos, l.n - l.pos) >= {overlap}"
    )
    of_post, at_first = posts.columns, posts.count()
    for draw in range(DRAWS):
        now = placed(posts, groups).withColumn("band", band)
        place = F.xxhash64("node", "token", F.lit(draw)).alias("h")
        drawn = now.groupBy("token", "band").agg(F.min(F.struct(place, "node", "n", "pos", "comp", "band")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
        drawn = drawn.groupBy("token").agg(F.collect_list("l").alias("leads"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("c")).where("lo != hi")
        now = now.join(drawn.select("token", "leads", "c"), "token").select(
            *of_post, (F.col("c") - F.size("leads")).alias("left"), F.expr("exists(leads, l -> l.node = node)").alias("led"), F.expr(f"transform(filter(leads, l -> {may_meet}), l -> l.node)").alias("met")
        )
        now = written(now, f"{root}/drawn{draw}")
        drawn_pairs = now.select("node", F.explode("met").alias("b")).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        found = links(drawn_pairs, f"drawn{draw}")
        groups = merged(groups, found)
        posts = now.where("not led").select(*of_post)
        # again where it pays: large groups of near copies hang together after a few draws, and shorter lists come to an end
        size = now.agg(F.countDistinct("node").alias("sets"), F.count_if(F.expr("not led and left > 1")).alias("left")).first()
        if DRAW_PAYS * found.count() < size.sets and LEFT_PAYS * size.left < at_first or not size.left:
            break

    # 4. pairs between components, from lists that still hold more than one
    signs = reps.select("node", *SIGNS)
    now = placed(posts, groups)
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    open_posts = written(now.join(mixed, "token").join(signs, "node"), f"{root}/open")
    x = open_posts.where("probe <= need").select("token", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "pos", "need", "comp", *SIGNS)])
    y = open_posts.select("token", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "pos", "index", "comp", *SIGNS)])
    overlap = f"ceil({num} * (n_x + n_y) / {num + den})"
    pairs = (
        x.join(y, "token")
        .where(
            f"comp_x != comp_y and index_y <= need_x and (n_x > n_y or (n_x = n_y and node_x > node_y)) and {den} * n_y >= {num} * n_x"
            f" and least(pos_x, pos_y) + least(n_x - pos_x, n_y - pos_y) >= {overlap} and {_may_link(num, den, '_x', '_y')}"
        )
        .groupBy("node_x", "node_y", "n_x", "n_y", "need_x")
        .agg(F.count("*").alias("shared"), F.min("pos_x").alias("px"), F.min("pos_y").alias("py"))
        .where(f"shared >= need_x and least(n_x - px, n_y - py) >= {overlap}")
        .select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    )
    other_links = links(pairs, "other")

    # 5. all links; a component's name is its smallest id
    groups = merged(groups, other_links)
    smallest = reps.select("sid", "node", "id").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = smallest.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = smallest.join(lowest, "comp").select("sid", "component_id")
    out = rows.join(named, "sid", "left").select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
    )
    out = cut(out)
    remove(spark, root)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one of each group of linked rows: the one with the smallest id (nulls last), then the first.

    ``docs`` is read twice and must give the same rows in the same places (a table does).
    """
    place = F.monotonically_increasing_id().alias("place")
    groups = jaccard_components(docs.select(place, docs[text_col].alias("t")), "place", "t", words, num, den)
    ids = docs.select(place, docs[id_col].alias("i"))
    first = groups.join(ids, "place").groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull(), "i", "place")).alias("m"))
    kept = first.select(F.col("m.place").alias("place"))
    return docs.select(F.struct(*docs.columns).alias("r"), place).join(kept, "place", "left_semi").select("r.*")
