"""List physical-plan features that do not scale, for every registered query.

usage: python tools/plan_audit.py [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioworks import registry  # noqa: E402
from folioworks.session import build_session  # noqa: E402

BAD = {
    "cross join": r"CartesianProduct|BroadcastNestedLoopJoin",
    "row-wise Python": r"BatchEvalPython",
    "single partition": r"Exchange SinglePartition",
    "unpartitioned window": r"No Partition Defined|Window \[[^\n]*\], \[[^\]]*(?:ASC|DESC)[^\]]*\]\n",
}


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("audit", "local[4]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
                                                 "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, item in registry.load().items():
        if args.names and name not in args.names:
            continue
        plan = item.run(spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        found = [label for label, pattern in BAD.items() if re.search(pattern, plan)]
        reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
        limits = len(re.findall("WindowGroupLimit", plan))
        print(f"{name:32s} {', '.join(found) or '-':40s} group limits {limits} scans {len(reads)}"
              f" pushed {sum(1 for p in pushed if p)}", flush=True)


if __name__ == "__main__":
    main()
