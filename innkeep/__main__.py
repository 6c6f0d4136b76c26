"""Command line: list, run or show the registered queries.

    python -m innkeep list
    python -m innkeep run room_inventory_report --data /data/driver [--out /data/out --format json] [--show 20]
    python -m innkeep sql room_inventory_report
    python -m innkeep explain room_inventory_report --data /data/driver

``run`` uses the session settings of :mod:`innkeep.session`; on a cluster,
start it with spark-submit and leave ``--master`` unset.
"""

from __future__ import annotations

import argparse
import sys

from .plans import catalog


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="innkeep")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="names of the registered queries")
    r = sub.add_parser("run", help="run one query")
    r.add_argument("name")
    r.add_argument("--data", required=True, help="directory with the driver tables (one Parquet file each)")
    r.add_argument("--out", help="write the result here (A4) instead of showing it")
    r.add_argument("--format", default="json", choices=["json", "csv", "parquet"])
    r.add_argument("--show", type=int, default=20)
    r.add_argument("--master", default=None)
    s = sub.add_parser("sql", help="print the DuckDB oracle SQL of a query")
    s.add_argument("name")
    e = sub.add_parser("explain", help="print the formatted physical plan of a query")
    e.add_argument("name")
    e.add_argument("--data", required=True)
    e.add_argument("--master", default=None)
    a = p.parse_args(argv)

    if a.cmd == "list":
        print("\n".join(catalog.names()))
        return 0
    if a.cmd == "sql":
        print(catalog.oracle_sql(a.name) or "-- no oracle")
        return 0

    from .session import get_spark
    from .sources.tables import write_report

    spark = get_spark(a.master)
    df = catalog.build(a.name, spark, a.data)
    if a.cmd == "explain":
        df.explain("formatted")
        return 0
    if a.out:
        write_report(df, a.out, a.format)
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
