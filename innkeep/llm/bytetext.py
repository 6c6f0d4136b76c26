"""Whole-column text helpers over Arrow buffers.

A batch of texts is one byte array plus offsets, so words, word hashes and
counts of thousands of documents take a few numpy passes.  All helpers treat
a null text as empty and never cut a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # documents are taken together up to this many bytes of text

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True outside the given closed byte ranges."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (a bijection)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` bytes (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for slices of a batch."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    for i, j in slices(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of ``table``: starts, ends, and the run offsets of each document.

    A run never crosses a document border.
    """
    inside = table[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def count_words(texts: pa.Array) -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` of each text (null: 0)."""
    data, offsets = buffers(texts)
    out = [np.zeros(0, np.int64)]
    for i, j in slices(offsets):
        out.append(np.diff(runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)[2]))
    return np.concatenate(out).astype(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 1 << 16)
        for name, base in (("_pow", _ODD), ("_inv", _ODD_INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _pow, _inv


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: differences of one polynomial prefix sum, mixed with the length."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE[data]
    values *= power[: len(data)]
    np.cumsum(values, out=sums[1:])
    del values
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lengths[0]-1, starts[1].. and so on."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if not len(s):
        return np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)
