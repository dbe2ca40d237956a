"""Summarise the physical plan of every registered query (for scale review).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Per key: shuffle exchanges, broadcast exchanges, join strategies, scans with pushed filters,
subqueries, whole-stage-codegen spans and any Python evaluation (there should be none).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from washkit.plans.queries import REGISTRY  # noqa: E402
from washkit.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    print("| key | shuffles | broadcasts | joins | scans (pushed filters) | subqueries | python |")
    print("|---|---|---|---|---|---|---|")
    for k in sorted(REGISTRY):
        df = REGISTRY[k](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("extended")
        text = buf.getvalue()
        plan = text[text.index("== Physical Plan =="):]
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning", plan))
        bcast = plan.count("BroadcastExchange")
        joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan)))
        scans = re.findall(r"FileScan parquet [^\n]*?PushedFilters: \[(.*?)\], ReadSchema", plan)
        tables = re.findall(r"Location: InMemoryFileIndex[^\[]*\[file:[^\]]*/([a-z_]+)\.parquet\]", plan)
        pushed = sum(1 for s in scans if s.strip())
        subq = plan.count("Subquery") + plan.count("ReusedSubquery")
        py = "yes" if re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", plan) else "no"
        print(f"| {k} | {shuffles} | {bcast} | {', '.join(joins) or '-'} | {len(scans)} ({pushed} with filters) "
              f"{','.join(sorted(set(tables)))} | {subq} | {py} |")


if __name__ == "__main__":
    main()
