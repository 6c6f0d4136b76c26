"""Property tests: nights (H3) and charge (H4) against the model's Python
arithmetic on generated values (one Spark job per generated batch)."""

import datetime as dt
from decimal import Decimal as D

from hypothesis import given, settings, strategies as st

from innkeep.functions import scalar as H

moments = st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2040, 1, 1))
pairs = st.lists(st.tuples(moments, moments), min_size=1, max_size=200)
rates = st.decimals(min_value=D("0.00"), max_value=D("99999.99"), places=2, allow_nan=False, allow_infinity=False)
bills = st.lists(st.tuples(st.integers(min_value=1, max_value=400), rates), min_size=1, max_size=200)


@settings(max_examples=15, deadline=None, derandomize=True, database=None)
@given(pairs)
def test_nights_match_python(spark, rows):
    df = spark.createDataFrame(rows, "i timestamp_ntz, o timestamp_ntz")
    got = [r.n for r in df.select(H.stay_nights("i", "o").alias("n")).collect()]
    want = []
    for a, b in rows:
        d = b - a
        want.append(max(1, d.days + (1 if d.seconds > 3600 * 12 else 0)))
    assert got == want


@settings(max_examples=15, deadline=None, derandomize=True, database=None)
@given(bills)
def test_charge_matches_python_round(spark, rows):
    df = spark.createDataFrame(rows, "n long, r decimal(10,2)")
    got = [r.c for r in df.select(H.stay_charge("n", "r").alias("c")).collect()]
    want = []
    for n, r in rows:
        rate = float(r) if r else 100.0
        want.append(D(str(round((n * rate) * 1.125, 2))).quantize(D("0.01")))
    assert got == want
