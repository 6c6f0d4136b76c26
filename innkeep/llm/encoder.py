"""Token ids of whole texts, through the `tokenizers` library, one call per distinct pre-token.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so
equal pre-tokens have equal ids.  A batch is split with numpy; the library
encodes the pre-tokens that this worker has not met, and their ids are looked
up for the rest.  Texts with characters whose class the byte rules don't
know go to the library.  Long texts are encoded in pieces of about ``PIECE``
bytes, cut where a pre-token begins whatever stands around it.  The pre-tokens follow the tokenizer's own
pattern (contractions, letters, digits, others, each with one leading space;
white space).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import bytetext as bt

MOST_KNOWN = 1_300_000  # pre-tokens a worker remembers before it starts anew
PIECE = 1 << 20  # bytes encoded at once
TABLE_BITS = 21
TABLE = 1 << TABLE_BITS

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER  # holds where every such character is a letter, see _plain


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of pieces of ``PIECE`` bytes or somewhat more: where a document ends, or one space stands between ASCII letters or digits.

    Such a space begins a pre-token.  Texts without one stay in one piece.
    """
    out, at, word = [], PIECE, (_CLASS[:128] == _LETTER) | (_CLASS[:128] == _DIGIT)
    word = np.concatenate([word, np.zeros(128, bool)])
    while at < len(data):
        end = int(offsets[np.searchsorted(offsets, at)])
        while at < end:
            seg = data[at - 1 : min(at + PIECE, end) + 1]
            hit = np.flatnonzero((seg[1:-1] == 0x20) & word[seg[:-2]] & word[seg[2:]])
            if len(hit):
                end = at + int(hit[0])
            at = min(at + PIECE, end)
        out.append(end)
        at = end + PIECE
    return [*out, len(data)] if not out or out[-1] < len(data) else out


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents whose only characters beyond ASCII are letters U+00C0 to U+017F."""
    nxt = np.append(data[1:], np.uint8(0))
    odd = (data >= 0xC0) & ~((data >= 0xC3) & (data <= 0xC5))
    odd |= (data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))  # multiplication and division signs
    bad = np.concatenate([[0], np.cumsum(odd)])
    return bad[offsets[1:]] == bad[offsets[:-1]]


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of plain documents, which cover each text whole."""
    n = len(data)
    kind = _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = first[:n].copy()
    if n > 1:
        start[1:] |= kind[1:] != kind[:-1]
        inner = ~first[1:n]
        # the last white space before other text stands alone, or with what follows if it is a space
        b = np.flatnonzero(inner & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
        start[b - 1] = True
        start[b[data[b - 1] == 0x20]] = False
        # contractions: an apostrophe that begins a pre-token of its own
        a = np.flatnonzero(data == 0x27)
        alone = first[a] | ((kind[a - 1] != _OTHER) & (data[a - 1] != 0x20))
        a = a[alone & (a + 1 < n)]
        a = a[~first[a + 1]]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        c1, c2 = padded[a + 1], padded[a + 2]
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = ((c1 == 0x72) | (c1 == 0x76)) & (c2 == 0x65) | (c1 == 0x6C) & (c2 == 0x6C)
        two &= ~first[np.minimum(a + 2, n)]
        for hit, k in ((one, 2), (two, 3)):
            at = a[hit]
            start[at + 1] = False
            rest = at + k
            rest = rest[rest < n]
            start[rest[(kind[rest] == _LETTER) & ~first[rest]]] = True
    return np.flatnonzero(start)


class Encoder:
    """Batch encoder that remembers pre-tokens; one per worker and tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self._clear()

    def _clear(self) -> None:
        """An open-addressing table from hash to place, and the ids of every place."""
        self.known = 0
        self.keys = np.zeros(TABLE, np.uint64)
        self.places = np.zeros(TABLE, np.int32)
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't known."""
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.places[slot], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (TABLE - 1)
            got = self.keys[slot[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = h[free]
            self.places[slot[free]] = place[free]
            open_ = open_[self.keys[slot[open_]] != h[open_]]
            slot[open_] = (slot[open_] + 1) & (TABLE - 1)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        base = self.known
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        while base + len(ids) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.count[base : base + len(ids)] = counts
        self.first[base : base + len(ids)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.known += len(ids)
        self._put(hashes, np.arange(base, self.known, dtype=np.int32))

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool of every pre-token, and the pre-token offsets of each document."""
        starts = split(data, offsets)
        bounds = np.append(starts, len(data))
        h = bt.hash_runs(data, starts, bounds[1:])
        h[h == 0] = 1  # 0 marks a free slot
        place = self._find(h)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if self.known + len(new) > MOST_KNOWN:
                self._clear()
                new, at = np.unique(h, return_index=True)
                missing = np.arange(len(h))
            raw = data.tobytes()
            s, e = starts[missing[at]].tolist(), bounds[missing[at] + 1].tolist()
            self._learn(new, [raw[a:b].decode() for a, b in zip(s, e)])
            place[missing] = self._find(h[missing])
        return place, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets of each) for texts as bytes and offsets."""
        sizes, out, a = np.zeros(len(offsets) - 1, np.int64), [], 0
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        for b in _cuts(data, offsets):
            # documents that reach into the piece
            d0, d1 = max(0, int(np.searchsorted(offsets, a, "right")) - 1), int(np.searchsorted(offsets, b))
            ids, at = self._piece(data[a:b], np.clip(offsets[d0 : d1 + 1], a, b) - a)
            sizes[d0:d1] += np.diff(at)
            out.append(ids)
            a = b
        return out[0] if len(out) == 1 else np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = _plain(data, offsets)
        lengths = np.diff(offsets)
        out_n = np.zeros(len(lengths), np.int64)
        sizes = np.where(plain, lengths, 0)
        keep = np.repeat(plain, lengths)
        place, at = self._places(data[keep] if not plain.all() else data, np.concatenate([[0], np.cumsum(sizes)]))
        per = self.count[place]
        sums = np.concatenate([[0], np.cumsum(per)])
        out_n += sums[at[1:]] - sums[at[:-1]]
        ids = self.pool[bt.ragged(self.first[place], per)]
        if plain.all():
            return ids, np.concatenate([[0], np.cumsum(out_n)])
        raw = data.tobytes()
        slow = np.flatnonzero(~plain)
        texts = [raw[offsets[d] : offsets[d + 1]].decode() for d in slow]
        whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        parts = np.split(ids, sums[at[1:-1]]) if len(plain) > 1 else [ids]
        for d, x in zip(slow, whole):
            parts[d] = x
            out_n[d] = len(x)
        return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum(out_n)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(path: str, texts: list[str | None]) -> list[list[int]]:
    """Token ids of a few texts (null: empty)."""
    data, offsets = bt.buffers(pa.array(texts, pa.string()))
    ids, at = encoder(path).encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]
