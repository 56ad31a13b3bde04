"""Run registered queries beside their oracle SQL and compare the rows.

usage: python tools/check_queries.py [--sf DIR] [--plan] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from folioworks import registry  # noqa: E402
from folioworks.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f{value!r}"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--plan", action="store_true")
    parser.add_argument("--match", default=None)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{args.sf}/{table}.parquet'")
    entries = registry.load()
    names = args.names or list(entries)
    if args.match:
        names = [n for n in names if args.match in n]
    bad = []
    for name in names:
        item = entries[name]
        try:
            start = time.time()
            df = item.run(spark, args.sf)
            if args.plan:
                df.explain("formatted")
            cols = sorted(df.columns)
            rows = [tuple(r[c] for c in cols) for r in df.collect()]
            spent = time.time() - start
            if not item.sql:
                print(f"ROWS  {name:45s} {len(rows):7d} rows {spent:6.2f}s", flush=True)
                if not rows:
                    bad.append(name)
                continue
            start = time.time()
            rel = db.execute(item.sql)
            ocols = [d[0] for d in rel.description]
            orows = [tuple(dict(zip(ocols, r))[c] for c in sorted(ocols)) for r in rel.fetchall()]
            ospent = time.time() - start
            left = Counter(tuple(canon(v) for v in r) for r in rows)
            right = Counter(tuple(canon(v) for v in r) for r in orows)
            ok = cols == sorted(ocols) and left == right and len(rows) > 0
            print(f"{'OK   ' if ok else 'FAIL '} {name:45s} {len(rows):7d} rows {spent:6.2f}s oracle {ospent:5.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", cols, sorted(ocols), len(rows), len(orows))
                for r in list((left - right).elements())[:3]:
                    print("   spark ", str(r)[:600])
                for r in list((right - left).elements())[:3]:
                    print("   oracle", str(r)[:600])
        except Exception as error:
            bad.append(name)
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
