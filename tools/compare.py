"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tools/compare.py /root/testdata/sf0.01 [--strict] [name ...]

Compares column names, row counts and the multiset of rows (order-free).
``--strict`` also requires the same Python value type per column and the same
text of every value (no float or decimal normalisation).
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from innkeep.plans import catalog  # noqa: E402
from innkeep.sources.tables import DRIVER_TABLES  # noqa: E402


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(directory, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, Decimal):
        return v.normalize()
    return v


def _strict_diff(df_columns, rows, ocols, orows) -> str | None:
    idx = [ocols.index(c) for c in df_columns]
    types_s, types_o = {}, {}
    for r in rows:
        for c, v in zip(df_columns, r):
            if v is not None:
                types_s.setdefault(c, set()).add(type(v).__name__)
    for r in orows:
        for c, i in zip(df_columns, idx):
            if r[i] is not None:
                types_o.setdefault(c, set()).add(type(r[i]).__name__)
    bad = {c: (types_s.get(c), types_o.get(c)) for c in df_columns
           if types_s.get(c) and types_o.get(c) and types_s[c] != types_o[c]}
    if bad:
        return f"value types differ {bad}"
    a = sorted(tuple(str(v) for v in r) for r in rows)
    b = sorted(tuple(str(r[i]) for i in idx) for r in orows)
    if a != b:
        return "value texts differ"
    return None


def compare(spark, directory: str, name: str, con=None, strict: bool = False) -> tuple[bool, str]:
    con = con or duck(directory)
    t0 = time.time()
    df = catalog.build(name, spark, directory)
    rows = df.collect()
    t1 = time.time()
    sql = catalog.oracle_sql(name)
    if sql is None:
        return True, f"{name}: {len(rows)} rows (no oracle) spark={t1 - t0:.2f}s"
    rel = con.sql(sql)
    cols = rel.columns
    orows = rel.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"{name}: columns differ spark={df.columns} oracle={cols}"
    order = [cols.index(c) for c in df.columns]
    a = Counter(tuple(_norm(v) for v in r) for r in rows)
    b = Counter(tuple(_norm(r[i]) for i in order) for r in orows)
    if a != b:
        only_a = list((a - b).elements())[:3]
        only_b = list((b - a).elements())[:3]
        return False, f"{name}: rows differ ({len(rows)} vs {len(orows)}) spark-only={only_a} oracle-only={only_b}"
    if strict:
        why = _strict_diff(df.columns, rows, cols, orows)
        if why:
            return False, f"{name}: {why}"
    return True, f"{name}: OK {len(rows)} rows spark={t1 - t0:.2f}s"


def main() -> int:
    from innkeep.session import get_spark

    args = sys.argv[1:]
    strict = "--strict" in args
    args = [a for a in args if a != "--strict"]
    directory = args[0]
    wanted = args[1:] or catalog.names()
    spark = get_spark("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    con = duck(directory)
    bad = 0
    for name in wanted:
        try:
            ok, msg = compare(spark, directory, name, con, strict)
        except Exception as e:  # report and go on
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
