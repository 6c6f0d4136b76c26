import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from innkeep.llm.encoder import encode_texts, public_path
from innkeep.llm.token_store import pack, read_tokens, round_trip, unpack, write_tokens


@settings(deadline=None, max_examples=60, derandomize=True)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_codes_round_trip(spans):
    n = np.array([len(s) for s in spans], np.int64)
    values = np.array([v for s in spans for v in s], np.uint32)
    control, control_at, data, data_at = pack(values, np.concatenate([[0], np.cumsum(n)]).astype(np.int64))
    assert np.diff(control_at).tolist() == [-(-k // 4) for k in n]
    assert unpack(control, data, n).tolist() == values.tolist()
    for k in range(len(spans)):  # every span stands alone
        one = unpack(control[control_at[k] : control_at[k + 1]], data[data_at[k] : data_at[k + 1]], n[k : k + 1])
        assert one.tolist() == spans[k]


def test_broken_codes_are_refused():
    control, _, data, _ = pack(np.array([1, 300, 70000], np.uint32), np.array([0, 3]))
    with pytest.raises(ValueError):
        unpack(control, data[:-1], np.array([3]))
    with pytest.raises(ValueError):
        unpack(control, data, np.array([9]))


def _expected(rows):
    out, start = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, _), ids in zip(rows, encode_texts(public_path(), [t for _, t in rows])):
        ids = ids + [0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_digests_of_all_documents(docs):
    got = [tuple(r) for r in round_trip(docs).collect()]
    assert sorted(got) == _expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows_and_many_parts(odd_docs, monkeypatch):
    import innkeep.llm.token_store as module

    monkeypatch.setattr(module, "PART_BYTES", 100_000)
    got = sorted((tuple(r) for r in round_trip(odd_docs).collect()), key=lambda r: r[1])
    want = _expected([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in want)
    assert [r[0] for r in got] == [r[0] for r in want]  # ids ascend, null first
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert round_trip(odd_docs.limit(0)).collect() == []


def test_files_hold_the_ids(spark, odd_docs, tmp_path):
    path = str(tmp_path / "tokens")
    few = odd_docs.where("doc_id = 12 or doc_id = 13")
    write_tokens(few, path)
    rows = {r.doc_id: r.ids for r in read_tokens(spark, path).collect()}
    texts = {r.doc_id: r.text for r in few.collect()}
    for i, text in texts.items():
        assert rows[i] == encode_texts(public_path(), [text])[0] + [0]
    ranks = {r.id: r.rank for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert sorted(ranks.values()) == list(range(len(ranks))) and ranks[0] == 0  # the end id is the most frequent
