"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

Format (a Parquet folder ``tokens`` with one row per document, in folders
``part=0, 1, ..`` that ascend by id, rows ascending by ``seq`` within, and a
folder ``ranks``): an id is replaced by its rank by frequency
(0 = the most frequent, ties by id); ranks take 1 to 4 little-endian bytes in
the column ``data``, and their lengths, less 1, take two bits each in the
column ``control``, first value in the lowest bits.  ``part`` and ``before``
place a document: ids before it within its part.  Decoding looks control
bytes up in a table of 256 rows and gathers bytes; it never walks values.

Edge cases: null text is the empty text and holds the end id alone; rows with
a null id come first; rows that share an id stand together, by text; an empty
table gives empty folders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bytetext as bt
from .encoder import encoder, public_path
from .storage import cut, new_path, remove, written

PART_BYTES = 32 << 20  # text bytes a part aims at
IDS = "part int, seq long, doc_id long, before long, n int, ids binary"
TOKENS = "part int, seq long, doc_id long, before long, n int, control binary, data binary"

#: lengths of the four values of a control byte
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the spans ``at`` of unsigned 32-bit values: control bytes and their spans, data bytes and theirs."""
    v = np.asarray(values, np.uint32)
    n = np.diff(at)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control_at = np.concatenate([[0], np.cumsum(-(-n // 4))])
    codes = np.zeros(int(control_at[-1]) * 4, np.uint8)
    codes[np.arange(len(v)) + np.repeat(4 * control_at[:-1] - at[:-1], n)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) < size[:, None]]
    return control, control_at, data, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[at]


def unpack(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of :func:`pack` (``n`` per span, one after another), by table lookup."""
    blocks = -(-n // 4)
    if int(blocks.sum()) != len(control):
        raise ValueError("control bytes don't fit the number of values")
    real = np.ones(4 * len(control), bool)
    first = 4 * (np.cumsum(blocks) - blocks)
    for k in range(1, 4):  # a last control byte has up to three places without a value
        short = 4 * blocks - n >= k
        real[(first + 4 * blocks - k)[short]] = False
    size = LENGTHS[control].reshape(-1)[real]
    end = np.cumsum(size, dtype=np.int64)
    if (int(end[-1]) if len(end) else 0) != len(data):
        raise ValueError("data bytes don't fit the control bytes")
    at = end - size
    raw = np.concatenate([data, np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max()) if len(size) else 1):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value per span of a flat array."""
    off = (at * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the spans of its values."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _ids(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """Token ids of a column of two or four bytes an id."""
    raw, at = _flat(column)
    wide = np.diff(at) == 4 * n
    if not wide.any():
        return raw.view(np.uint16).astype(np.uint32)
    parts = np.split(raw, at[1:-1])
    return np.concatenate([p.view(np.uint32 if w else np.uint16).astype(np.uint32) for p, w in zip(parts, wide)])


def _some(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` values each, by the counts in ``column``."""
    n = batch.column(batch.schema.get_field_index(column)).to_numpy()
    for i, j in bt.slices(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), most):
        yield batch.slice(i, j - i)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = seq = 0  # a task holds one part, in order
        for batch in batches:
            part, doc = batch.column(0), batch.column(1)
            for i, j, data, offsets in bt.text_slices(batch):
                ids, at = encoder(path).encode(data, offsets)
                n = np.diff(at)
                whole = np.full(len(ids) + len(n), end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                at = at + np.arange(len(at))
                small = whole.astype(np.uint16) if not len(whole) or whole.max() < 1 << 16 else whole
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [part.slice(i, m), pa.array(np.arange(seq, seq + m)), doc.slice(i, m), pa.array(before + at[:-1]), pa.array(np.diff(at), pa.int32()), _binary(small, at)],
                    names=["part", "seq", "doc_id", "before", "n", "ids"],
                )
                before, seq = before + len(whole), seq + m

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part in _some(batch, "n"):
            c = np.bincount(_ids(part.column(1), part.column(0).to_numpy()))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "c"])


def _pack(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            for part in _some(batch, "n"):
                n = part.column(4).to_numpy()
                control, control_at, data, data_at = pack(rank[_ids(part.column(5), n)], np.concatenate([[0], np.cumsum(n, dtype=np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:5], _binary(control, control_at), _binary(data, data_at)],
                    names=["part", "seq", "doc_id", "before", "n", "control", "data"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every text, append ``end_id``, and write ``path/tokens`` and ``path/ranks``.

    Parts are ranges of ids holding about ``PART_BYTES`` of text each; an id
    that holds more is cut by its rows' texts and places, so that no key makes
    a part of its own size.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    placed = base.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "row")
    placed = placed.sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ids = written(placed.mapInArrow(_encode(tokenizer, end_id), IDS), f"{path}/ids")
    # one row per token id in use: at most the vocabulary
    counts = ids.select("n", "ids").mapInArrow(_counts, "id int, c long").groupBy("id").agg(F.sum("c").alias("c"))
    ranked = counts.select("id").orderBy(F.desc("c"), "id").toPandas()["id"].to_numpy(np.int64)
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame([(int(i), k) for k, i in enumerate(ranked)], "id int, rank int").coalesce(1).write.parquet(f"{path}/ranks")
    packed = ids.mapInArrow(_pack(spark.sparkContext.broadcast(rank)), TOKENS).sortWithinPartitions("part", "seq")
    packed.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/tokens")
    remove(spark, f"{path}/ids")


def _starts(tokens: DataFrame) -> DataFrame:
    """``(part, base)``: ids before each part, by groups of 1,000 parts."""
    per = tokens.groupBy("part").agg(F.sum("n").cast("long").alias("n")).withColumn("g", F.floor(F.col("part") / 1000))
    inner = per.withColumn("b", F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n"))
    groups = per.groupBy("g").agg(F.sum("n").alias("gn"))
    groups = groups.withColumn("gb", F.sum("gn").over(Window.orderBy("g")) - F.col("gn"))
    return inner.join(groups, "g").select("part", (F.col("b") + F.col("gb")).alias("base"))


def _decode(table, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = table.value
        for batch in batches:
            for part in _some(batch, "n"):
                n = part.column(4).to_numpy()
                ids = ids_of[unpack(_flat(part.column(5))[0], _flat(part.column(6))[0], n)].astype("<u4")
                at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                if digest:
                    raw, spans = memoryview(ids.tobytes()), (4 * at).tolist()
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(spans, spans[1:])], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), part.column(4).cast(pa.int64()), last],
                    names=["part", "doc_id", "before", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the decoded ``ids`` (or, with ``digest``, their ``ids_crc32``) of every document."""
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens").select("part", "seq", "doc_id", "before", "n", "control", "data")
    ranks = spark.read.schema("id int, rank int").parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    kind = "ids_crc32 long" if digest else "ids array<int>"
    rows = tokens.mapInArrow(_decode(spark.sparkContext.broadcast(ranks), digest), f"part int, doc_id long, before long, n_tokens long, {kind}")
    return rows.join(_starts(tokens), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", kind.split()[0])


def round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the files and read them back as digests: ``doc_id, start, n_tokens, ids_crc32``.

    Files below ``path`` stay; without it they go to the shared folder and are
    removed once read.
    """
    spark = docs.sparkSession
    target = path or new_path(spark, "token-ids")
    write_tokens(docs, target, tokenizer)
    out = cut(read_tokens(spark, target, digest=True))
    if path is None:
        remove(spark, target)
    return out
