"""Periodic run detection by recompression.

A run of a text's words is a stretch with smallest period q, at least
``max(least, exponent * q)`` words long, that no neighbouring word extends
keeping period q.  Per text:

1. candidates: a run is long enough to hold, for its period q, a point i of the
   grid of multiples of ``max(q, least - 2q)`` together with i + 2q (over all q
   the grids form a harmonic sum, n log n points).  Points where the words at
   i, i + q and i + 2q, or a few places between, differ are no candidates;
2. a run-length grammar of the text, built where candidates are left:
   alternately, blocks of one symbol are replaced by (symbol, count) rules, and
   pairs of adjacent symbols, the left one of one half of the alphabet and the
   right one of the other, by pair rules.  Equal stretches are parsed alike but
   for their ends, whatever surrounds them;
3. the exact extension of a candidate's period to both sides is a longest
   common extension of i and i + q.  It climbs the grammar while both places
   are ends of rules, skipping equal symbols (blocks by their common count),
   compares at the top, and descends to the first differing word: a bounded
   number of steps a level, for all candidates at once;
4. stretches long enough are runs; of equal stretches the smallest period is
   the run's (a larger one found with it is a multiple).

A text is processed whole in one task; its arrays take up to 17 bytes of memory
per byte of text (measured at 40 MB), and a task holds one grammar at a time.

Edge cases: null, empty and all-space texts have no words and no runs; null ids
stay null; repeated rows are each answered; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LEAST = 24  # words of a run
EXPONENT = 3  # periods of a run
HELD = 1 << 20  # candidates resolved at once
ROUNDS = 400  # pair rounds; a text of n words needs about 3 log n


class Grammar:
    """Run-length grammar of a sequence of words (small integers), level by level.

    ``levels[l]`` is ``symbols, parent, first, block``: the symbols of level l,
    the place on level l + 1 of the rule that each belongs to, the place of
    each rule's first symbol (one place more than rules), and whether rules
    are blocks.  Two symbols of their own mark the ends of the text.
    """

    def __init__(self, words: np.ndarray):
        top = int(words.max(initial=-1)) + 1
        symbols = np.concatenate([[top], words, [top + 1]]).astype(np.int64)
        ends, fresh = (top, top + 1), top + 2
        self.levels = []
        for turn in range(ROUNDS):
            if len(symbols) <= 3:
                break
            start = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            if not start.all():
                first = np.flatnonzero(start)
                count = np.diff(first, append=len(symbols))
                above = symbols[first]
                many = count > 1
                rules, name = np.unique(above[many] << 32 | count[many], return_inverse=True)
                above[many] = fresh + name
                fresh += len(rules)
                self._push(symbols, start, first, True)
                symbols = above
            pair = self._pairs(symbols, ends, turn)
            if pair.any():
                start = np.concatenate([[True], ~pair])
                first = np.flatnonzero(start)
                above = symbols[first]
                left = np.flatnonzero(pair)
                rules, name = np.unique(symbols[left] << 32 | symbols[left + 1], return_inverse=True)
                above[np.searchsorted(first, left)] = fresh + name
                fresh += len(rules)
                self._push(symbols, start, first, False)
                symbols = above
        self.top = symbols

    def _push(self, symbols: np.ndarray, start: np.ndarray, first: np.ndarray, block: bool) -> None:
        parent = (np.cumsum(start) - 1).astype(np.int32)
        self.levels.append((symbols, parent, np.append(first, len(symbols)).astype(np.int32), block))

    @staticmethod
    def _pairs(symbols: np.ndarray, ends: tuple[int, int], turn: int) -> np.ndarray:
        """Whether a place and the next one form a pair, by the halves of the alphabet that pair more."""
        half = ((symbols * 0x9E3779B1 + turn * 0x85EBCA6B) & 0xFFFFFFFF) * 0xC2B2AE35 >> 29 & 1
        inner = (symbols[:-1] != ends[0]) & (symbols[1:] != ends[1])
        up = inner & (half[:-1] < half[1:])
        down = inner & (half[:-1] > half[1:])
        return up if up.sum() >= down.sum() else down

    def extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """Number of equal words from i and j on (step 1), or back (step -1), for arrays i < j of word numbers."""
        x, y = i.astype(np.int64) + 1, j.astype(np.int64) + 1  # the left end mark comes first
        height = len(self.levels)
        stop = np.full(len(x), height)
        live = np.arange(len(x))
        for level, (symbols, parent, first, _) in enumerate(self.levels):
            xl, yl = x[live], y[live]
            px, py = parent[xl], parent[yl]
            if step > 0:  # symbols left in the rule; whether the place is the rule's end
                rx, ry = first[px + 1] - xl, first[py + 1] - yl
                whole = (first[px] == xl) & (first[py] == yl)
            else:
                rx, ry = xl - first[px] + 1, yl - first[py] + 1
                whole = (first[px + 1] - 1 == xl) & (first[py + 1] - 1 == yl)
            equal = symbols[xl] == symbols[yl]
            ahead = np.where(whole | ~equal, 0, np.minimum(rx, ry)) * step
            xl, yl = xl + ahead, yl + ahead
            climbs = whole | (equal & (rx == ry))
            x[live] = np.where(climbs, parent[xl], xl)
            y[live] = np.where(climbs, parent[yl], yl)
            stop[live[~climbs]] = level
            live = live[climbs]
        while len(live):
            live = live[self.top[x[live]] == self.top[y[live]]]
            x[live] += step
            y[live] += step
        for level in range(height - 1, -1, -1):
            symbols, _, first, block = self.levels[level]
            down = np.flatnonzero(stop > level)
            xu, yu = x[down], y[down]
            if step > 0:
                xl, yl = first[xu].astype(np.int64), first[yu].astype(np.int64)
            else:
                xl, yl = first[xu + 1].astype(np.int64) - 1, first[yu + 1].astype(np.int64) - 1
            equal = symbols[xl] == symbols[yl]
            both = np.minimum(first[xu + 1] - first[xu], first[yu + 1] - first[yu]) if block else 1
            ahead = np.where(equal, both, 0) * step
            x[down], y[down] = xl + ahead, yl + ahead
        return (x - 1 - i) * step


def _likely(words: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which candidates keep their period at a few places between i and i + 2q."""
    ok = np.ones(len(i), bool)
    for t in (1, q // 2, q // 3, q // 4 * 3, q - 1):
        at = i + np.minimum(t, q)
        ok &= words[at] == words[at + q]
    return ok


def _grid(words: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates ``i, q`` in pieces, periods ascending up to the root of the length, then by place in the grid."""
    n = len(words)
    longest = n // exponent if n >= least else 0
    root = min(longest, max(int(n**0.5), least))
    for q in range(1, root + 1):
        grid = max(q, least - 2 * q)
        a, b, c = words[:-2 * q:grid], words[q:n - q:grid], words[2 * q::grid]
        hit = np.flatnonzero((a == b) & (b == c)) * grid
        if len(hit):
            yield hit, np.full(len(hit), q)
    k = 0
    while longest > root and (k + 2) * (root + 1) < n:
        # the k-th point of every longer period
        q = np.arange(root + 1, min(longest, (n - 1) // (k + 2)) + 1)
        w = words[k * q]
        q = q[(w == words[(k + 1) * q]) & (w == words[(k + 2) * q])]
        if len(q):
            yield k * q, q
        k += 1


def runs_of(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of a sequence of word numbers, by start, then period."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    found: dict[tuple[int, int], int] = {}
    grammar = None
    reach = np.zeros(len(words), np.int64)  # end and period of a run over each word
    beat = np.ones(len(words), np.int64)

    def resolve(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal grammar
        i, q = (np.concatenate(c) for c in zip(*held))
        # a known run that holds i and i + 2q answers for multiples of its period
        known = (reach[i] > i + 2 * q) & (q % beat[i] == 0)
        i, q = i[~known], q[~known]
        ok = _likely(words, i, q)
        i, q = i[ok], q[ok]
        if not len(i):
            return
        grammar = grammar or Grammar(words)
        start = i - grammar.extend(i - 1, i + q - 1, -1)
        end = i + q + grammar.extend(i, i + q, 1)
        long = end - start >= np.maximum(least, exponent * q)
        for s, e, p in np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0).tolist():
            if found.get((s, e), p + 1) > p:
                found[s, e] = p
                wins = reach[s:e] < e
                reach[s:e][wins], beat[s:e][wins] = e, p

    held, size = [], 0
    for piece in _grid(words, least, exponent):
        held.append(piece)
        size += len(piece[0])
        if size >= HELD or len(held) == 1 and not found:
            resolve(held)
            held, size = [], 0
    if held:
        resolve(held)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin (one place more than texts)."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    values, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return values.filter(real), before[offsets - offsets[0]]


def _detect(least: int, exponent: int):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = _words(batch.column(1))
        numbers = values.dictionary_encode().indices.to_numpy().astype(np.int64)
        keep = np.ones(len(numbers), bool)
        runs = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            runs.append(runs_of(numbers[a:b], least, exponent))
            for s, length, p in runs[-1]:
                keep[a + s + p : a + s + length] = False
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), values.filter(pa.array(keep)))
        rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
        collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(rows, run_type), collapsed], names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield one(batch.slice(i, 256))

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (array of start, length, period, by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without the words
    that a run contains after its first period.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    found = rows.mapInArrow(_detect(least, exponent), "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
