"""Language ID by a linear-chain conditional random field over words.

Each word has hashed features: byte n-grams of 2 to 5 with word borders (those
at a border are the affixes) and, for words of the lexicon, the word.
Transitions are learned with them, from sequences in which spans of documents
of different languages follow one another, so words of code-switched texts get
labels of their own.  Words are labelled by forward-backward posteriors; a
document's language has the greatest mean posterior, which is its score.

The model is fitted, in one task, on a bounded sample of labelled rows
(``SAMPLE`` documents a language on average, chosen by a hash of the id, never
more than twice that in total, and of each a span of at most ``SPAN``
characters, placed by a hash), everything else runs over all rows and whole texts.  A document's chain is never
cut: blocks of ``BLOCK`` words are reduced to transfer matrices, whose products
give exact messages at every block border.

Edge cases: null text, or text without any letter, is ``und`` with score 0; so
is every row when no labelled row can be learned from.  Null languages and ids
aren't learned from.
"""

from __future__ import annotations

import multiprocessing
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytetext as bt

SAMPLE = 120
SPAN = 8192  # so the sample has at most 2 * SAMPLE * SPAN characters a language
BUCKET_BITS = 18
GRAMS = (2, 3, 4, 5)
LEXICON_COUNT = 5  # a word of the lexicon occurs so often in the sample
SEQUENCE = 64
STEPS = 40
BLOCK = 64
UNDETERMINED = "und"

#: A-Z, a-z and all bytes of characters beyond ASCII
WORD = bt.byte_set((0, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Words:
    """Words of a slice of texts: hashes, places in the table of distinct words, and its features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = bt.lower(data)
        starts, ends, self.at = bt.runs(low, offsets, WORD)
        self.hashes = bt.hash_runs(low, starts, ends)
        self.distinct, first, self.place = np.unique(self.hashes, return_index=True, return_inverse=True)
        s, n = starts[first], (ends - starts)[first]
        begin = np.concatenate([[0], np.cumsum(n + 2)])
        padded = np.empty(begin[-1], np.uint64)
        padded[begin[:-1]] = 2
        padded[begin[1:] - 1] = 3
        src = bt.ragged(s, n)
        padded[src + np.repeat(begin[:-1] + 1 - s, n)] = low[src]
        word = np.repeat(np.arange(len(n)), n + 2)
        left = begin[1:][word] - np.arange(len(padded))
        owners, buckets = [], []
        key = padded.copy()
        for g in range(2, max(GRAMS) + 1):
            key[: len(key) - g + 1] |= padded[g - 1 :] << np.uint64(8 * (g - 1))
            if g in GRAMS:
                ok = left >= g
                owners.append(word[ok])
                buckets.append((bt.mix(key[ok] ^ np.uint64(g << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        self.owner, self.bucket = np.concatenate(owners), np.concatenate(buckets)


class Model:
    """``labels``, n-gram weights, lexicon and its weights, log transition weights."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: np.ndarray, lex_weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.lexicon, self.lex_weights, self.trans = labels, weights, lexicon, lex_weights, trans

    def in_lexicon(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.lexicon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        hit = np.flatnonzero(self.lexicon[k] == hashes)
        return hit, k[hit]

    def emissions(self, words: Words) -> np.ndarray:
        """Score of each label for each distinct word."""
        n = len(words.distinct)
        out = np.stack([np.bincount(words.owner, self.weights[words.bucket, l], n) for l in range(len(self.labels))], 1).astype(float)
        hit, k = self.in_lexicon(words.distinct)
        out[hit] += self.lex_weights[k]
        return out

    def posteriors(self, words: Words) -> np.ndarray:
        """Posterior of each label for every word, documents being chains."""
        e = self.emissions(words)
        e = np.exp(e - e.max(1, keepdims=True))
        return chain_posteriors(e[words.place], words.at, np.exp(self.trans - self.trans.max()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def chain_posteriors(e: np.ndarray, at: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Forward-backward over chains ``at`` with emission factors ``e`` and transition factors ``t``.

    Exact: transfer matrices of blocks, messages at block borders along each
    chain, then all blocks at once.
    """
    n, size = len(e), t.shape[0]
    if not n:
        return np.zeros((0, size))
    lengths = np.diff(at)
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    first_block = np.cumsum(blocks) - blocks
    nth = np.arange(len(chain)) - first_block[chain]
    begin = at[:-1][chain] + nth * BLOCK
    count = np.minimum(at[1:][chain] - begin, BLOCK)
    index = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    real = np.arange(BLOCK) < count[:, None]
    x = e[index]  # blocks, places, labels
    m = np.broadcast_to(np.eye(size), (len(chain), size, size)).copy()
    for k in range(BLOCK):
        on = real[:, k]
        step = (m[on].reshape(-1, size) @ t).reshape(-1, size, size) * x[on, k][:, None, :]
        m[on] = step / np.maximum(step.max((1, 2), keepdims=True), 1e-300)
    fore = np.full((len(chain), size), 1.0 / size)
    back = np.ones((len(chain), size))
    for k in range(1, int(blocks.max())):
        b = first_block[blocks > k] + k
        fore[b] = _unit((fore[b - 1][:, None, :] @ m[b - 1])[:, 0])
        last = first_block[blocks > k] + blocks[blocks > k] - 1 - k
        back[last] = _unit((m[last + 1] @ back[last + 1][:, :, None])[:, :, 0])
    alpha = np.empty_like(x)
    a = fore
    for k in range(BLOCK):
        a = np.where(real[:, k, None], _unit((a @ t) * x[:, k]), a)
        alpha[:, k] = a
    b = back
    for k in range(BLOCK - 1, -1, -1):
        alpha[:, k] *= b
        b = np.where(real[:, k, None], _unit((b * x[:, k]) @ t.T), b)
    return _unit(alpha[real])


def fit(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 1) -> Model:
    """Maximum-likelihood CRF (L2) of labelled texts, by Adam over all sequences of the sample."""
    labels = sorted(set(languages))
    size = len(labels)
    rng = np.random.default_rng(seed)
    data, offsets = bt.buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    gold_doc = np.array([labels.index(x) for x in languages], np.int64)
    gold = np.repeat(gold_doc, np.diff(words.at))
    # half of the words stay in order, the others are dealt anew in spans of 4 to 32
    n = len(gold)
    order = np.arange(n)
    cuts, i = [], n // 2
    while i < n:
        j = min(n, i + int(rng.integers(4, 33)))
        cuts.append(order[i:j])
        i = j
    rng.shuffle(cuts)
    order = np.concatenate([order[: n // 2], *cuts]) if cuts else order
    rows = max(1, n // SEQUENCE)
    order = np.resize(order, rows * SEQUENCE) if n else order
    word, y = words.place[order].reshape(rows, -1), gold[order].reshape(rows, -1)
    often = np.bincount(words.place, minlength=len(words.distinct)) >= LEXICON_COUNT
    lexicon = words.distinct[often]
    model = Model(labels, np.zeros((1 << BUCKET_BITS, size)), lexicon, np.zeros((len(lexicon), size)), np.zeros((size, size)))
    hit, k = model.in_lexicon(words.distinct)
    params = [model.weights, model.lex_weights, model.trans]
    moment = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    onehot = np.eye(size)
    total = rows * SEQUENCE
    observed = np.zeros((size, size))
    np.add.at(observed, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
    for it in range(1, steps + 1):
        e = model.emissions(words)
        e = np.exp(e - e.max(1, keepdims=True))
        t = np.exp(model.trans - model.trans.max())
        x = e[word]
        alpha, beta = np.empty_like(x), np.empty_like(x)
        a = _unit(x[:, 0] * (np.full(size, 1.0 / size) @ t))
        alpha[:, 0] = a
        for s in range(1, SEQUENCE):
            a = alpha[:, s] = _unit((a @ t) * x[:, s])
        b = np.ones((rows, size))
        beta[:, -1] = b
        expected = np.zeros((size, size))
        for s in range(SEQUENCE - 1, 0, -1):
            right = b * x[:, s]
            pair = alpha[:, s - 1][:, :, None] * t * right[:, None, :]
            expected += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
            b = beta[:, s - 1] = _unit(right @ t.T)
        post = _unit(alpha * beta)
        diff = (onehot[y] - post).reshape(-1, size)
        flat = word.reshape(-1)
        per_word = np.stack([np.bincount(flat, diff[:, l], len(e)) for l in range(size)], 1)
        grads = [
            np.stack([np.bincount(words.bucket, per_word[words.owner, l], 1 << BUCKET_BITS) for l in range(size)], 1),
            np.zeros_like(model.lex_weights),
            observed - expected,
        ]
        grads[1][k] = per_word[hit]
        for p, g, m, v in zip(params, grads, moment, second):
            g = g / total - 1e-6 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for i, j, data, offsets in bt.text_slices(batch):
                n = j - i
                label, score = np.zeros(n, np.int64), np.zeros(n)
                if crf is not None and len(data):
                    words = Words(data, offsets)
                    sums = np.concatenate([np.zeros((1, len(crf.labels))), np.cumsum(crf.posteriors(words), 0)])
                    per = np.diff(words.at)
                    mean = (sums[words.at[1:]] - sums[words.at[:-1]]) / np.maximum(per, 1)[:, None]
                    label = mean.argmax(1)
                    score = np.clip(mean.max(1), 0, 1)
                    # characters beyond ASCII need not be letters: such documents are looked at one by one
                    ascii_letters = np.concatenate([[0], np.cumsum(WORD[data] & (data < 0x80))])
                    bare = ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]
                    for d in np.flatnonzero(bare & (per > 0)):
                        if not _has_letter(data[offsets[d] : offsets[d + 1]].tobytes()):
                            per[d] = 0
                    names = np.where(per > 0, np.array(crf.labels, object)[label], UNDETERMINED)
                    score = np.where(per > 0, score, 0.0)
                else:
                    names = np.full(n, UNDETERMINED, object)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, n) for c in batch.columns[:-1]], pa.array(names, pa.string()), pa.array(score)],
                    names=[*batch.schema.names[:-1], "lang_pred", "score"],
                )

    return run


def _label_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for i, j, data, offsets in bt.text_slices(batch):
                words = Words(data, offsets)
                post = crf.posteriors(words)
                starts, ends, at = bt.runs(data, offsets, WORD)
                raw = data.tobytes()
                names = np.array(crf.labels, object)[post.argmax(1)] if len(post) else []
                docs = []
                for d in range(j - i):
                    docs.append([{"word": raw[starts[k] : ends[k]].decode(), "lang": names[k], "score": float(post[k].max())} for k in range(at[d], at[d + 1])])
                kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], pa.array(docs, kind)], names=[*batch.schema.names[:-1], "words"])

    return run


def fit_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE, span: int = SPAN) -> Model | None:
    """Fit on a bounded sample of the rows outside the held-out fold (None without labelled rows)."""
    own = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    own = own.where("t is not null and l is not null").where(F.crc32(F.col("i").cast("binary")) % folds != held)
    counts = {r.l: r["count"] for r in own.groupBy("l").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.element_at(F.create_map(*[x for l, c in counts.items() for x in (F.lit(l), F.lit(min(1.0, sample / c)))]), F.col("l"))
    drawn = F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)
    start = F.pmod(F.xxhash64("i", F.lit(11)), F.greatest(F.lit(1), F.char_length("t") - span + 1)).cast("int") + 1
    rows = own.where(drawn).limit(2 * sample * len(counts)).select("i", F.substring("t", start, F.lit(span)).alias("t"), "l")
    fitted = rows.coalesce(1).mapInArrow(_fitted, "model binary").collect()  # one row
    return pickle.loads(fitted[0].model) if fitted else None


def _dumped(texts: list[str], languages: list[str]) -> bytes:
    return pickle.dumps(fit(texts, languages))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole (bounded) sample in one task: the model fitted on it, by a child process.

    Workers go on to other tasks; what the fit allocates goes back when the child ends.
    """
    rows = sorted((r["i"], r["t"], r["l"]) for batch in batches for r in batch.to_pylist())
    if rows:
        with multiprocessing.get_context("fork").Pool(1) as child:
            model = child.apply(_dumped, ([t for _, t, _ in rows], [l for _, _, l in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])


def _identified(docs: DataFrame, first: list[Column], kinds: str, id_col: str, text_col: str, lang_col: str, folds: int, held: int, model: Model | None) -> DataFrame:
    model = model or fit_sample(docs, id_col, text_col, lang_col, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*first, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, model: Model | None = None) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row; ids and languages are used to learn only."""
    first = [F.col(id_col).cast("long").alias("id"), (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held).alias("held_out")]
    return _identified(docs, first, "id long, held_out boolean", id_col, text_col, lang_col, folds, held, model).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows, with their own columns, whose language isn't ``und``.

    The score isn't looked at: it is a mean over the document's words, so a text
    evenly of n languages has about 1/n however certain its words are.
    """
    kind = docs.select(F.struct(*docs.columns).alias("r")).schema["r"].dataType.simpleString()
    out = _identified(docs, [F.struct(*docs.columns).alias("r")], f"r {kind}", id_col, text_col, lang_col, 4, 2, model)
    return out.where(F.col("lang_pred") != UNDETERMINED).select("r.*")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, words``: each document's words with language and posterior, in order (null text: none)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_label_words(docs.sparkSession.sparkContext.broadcast(model)), "id long, words array<struct<word string, lang string, score double>>")
    return out.withColumnRenamed("id", id_col)
