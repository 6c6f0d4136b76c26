import random

import numpy as np
import pyarrow as pa

from innkeep.llm import bytetext as bt
from innkeep.llm.encoder import encode_texts, encoder, public_path


def test_words_and_hashes_follow_the_text():
    texts = ["a  b\tc", None, "", " x ", "ab é\x0bz"]
    data, offsets = bt.buffers(pa.array(texts))
    starts, ends, at = bt.runs(data, offsets, bt.NOT_SPACE)
    raw = data.tobytes()
    words = [raw[s:e] for s, e in zip(starts, ends)]
    assert words == [w for t in texts for w in (t or "").encode().split()]
    assert np.diff(at).tolist() == [3, 0, 0, 1, 3] == bt.count_words(pa.array(texts)).tolist()
    h = bt.hash_runs(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words))
    again = bt.hash_runs(data, starts[::-1], ends[::-1])
    assert (again[::-1] == h).all()


def test_slices_hold_whole_documents():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    parts = list(bt.slices(offsets, 10))
    assert [p for p in parts] == [(0, 2), (2, 3), (3, 5)]


def test_ids_equal_the_library_on_odd_texts():
    rng = random.Random(3)
    plain = ["'", "s", "t", "re", "ll", "d", "m", "ve", " ", "  ", "\n", "\t", "a", "B", "9", "é", "×", "ß", "!", "--"]
    odd = plain + ["\x85", "\xa0", "日本", "<|endoftext|>", "\x1c", "ſ", "²", "́"]
    texts = ["".join(rng.choices(odd if k % 2 else plain, k=rng.randint(0, 14))) for k in range(4000)] + [None, ""]
    path = public_path()
    expected = [e.ids for e in encoder(path).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encode_texts(path, texts) == expected
    assert encode_texts(path, texts) == expected  # from the remembered pre-tokens


def test_a_worker_that_forgets_still_encodes(monkeypatch):
    import innkeep.llm.encoder as module

    monkeypatch.setattr(module, "MOST_KNOWN", 5)
    e = module.Encoder(public_path())
    for text in ("one two three four", "five six seven eight nine ten", "one nine"):
        data, offsets = bt.buffers(pa.array([text]))
        assert e.encode(data, offsets)[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_of_long_texts_give_the_ids_of_the_whole(monkeypatch):
    import innkeep.llm.encoder as module

    rng = random.Random(8)
    parts = ["a", "word", "don't", " ", " ", "  ", "\n", " '", "9", "é", "日本", "\xa0", "!", "<|endoftext|>", "x y", "1 2"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 200))) for _ in range(300)] + ["", None, "no" * 200, "", " " * 100, "a b " * 50]
    path = public_path()
    expected = [e.ids for e in encoder(path).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(module, "PIECE", piece)
        assert encode_texts(path, texts) == expected
        data, offsets = bt.buffers(pa.array(texts, pa.string()))
        cuts = module._cuts(data, offsets)
        assert cuts == sorted(set(cuts)) and cuts[-1] == len(data)
    monkeypatch.setattr(module, "PIECE", 64)
    data, offsets = bt.buffers(pa.array(["a b " * 50]))
    assert max(np.diff([0, *module._cuts(data, offsets)])) <= 66
    assert encode_texts(path, ["", None]) == [[], []] and encode_texts(path, []) == []
