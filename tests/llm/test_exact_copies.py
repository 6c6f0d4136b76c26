import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from innkeep.llm.exact_copies import copy_groups, drop_copies

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "digest"]


def brute(rows):
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), b in zip(rows, body):
        groups[b].append(i)
    keep = {b: min((i for i in ids if i is not None), default=None) for b, ids in groups.items()}
    out, seen = [], set()
    for (i, _), b in zip(rows, body):
        stays = i == keep[b] and b not in seen
        if stays:
            seen.add(b)
        out.append((i, keep[b], len(groups[b]), stays, hashlib.sha256(b.encode()).digest()))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def answered(df):
    return ordered(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*COLUMNS).collect())


TEXTS = ["a b", "a  b", "a\n\tb", " a b", "a b ", "", None, "\x0b", "a b", "A b", "long " * 50000]


@pytest.fixture
def rows():
    out = [(k * 3 % 17, t) for k, t in enumerate(TEXTS * 2)]
    out += [(1000 + k, "hot  text" if k % 2 else "hot\ttext") for k in range(300)] + [(9, "twice")] * 2500 + [(None, "no id")] * 3 + [(None, "a b")]
    return out


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answered(copy_groups(df)) == brute(rows)


def test_texts_of_one_digest_stay_apart(spark, rows):
    """A digest that clashes: every stage compares whole texts."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = copy_groups(df, digest=lambda body: F.when(F.length(body) > 9, F.unhex(F.lit("AA"))).otherwise(F.unhex(F.sha2(body, 256))))
    assert [r[:4] for r in answered(got)] == ordered([r[:4] for r in brute(rows)])


def test_kept_rows_are_whole(spark, rows):
    named = [(i, t, "x", k, {"a": 1}) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(named, "doc_id long, text string, digest string, row int, body map<string,int>").repartition(3)
    got = drop_copies(df)
    assert got.schema == df.schema
    keys = ordered((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in got.collect())
    assert keys == ordered((b[0], t) for b, t in {(r, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for r in brute(rows) if r[3] for _, t in [next(x for x in rows if x[0] == r[0] and hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or "").encode()).digest() == r[4])]})
    assert {r.row for r in got.collect()} <= set(range(len(rows)))


def test_odd_documents(spark, odd_docs):
    assert answered(copy_groups(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert copy_groups(odd_docs.limit(0)).collect() == [] and drop_copies(odd_docs.limit(0)).collect() == []
