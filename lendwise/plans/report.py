"""Summarize the physical plan of every registered key (run: python -m lendwise.plans.report <sf_dir>).

Counts come from the initial adaptive plan (before runtime re-planning): hash/range exchanges, single-partition
exchanges (global aggregates' final merge, bounded windows), join strategies, file scans, and whether column
pruning / pushed filters reach the scans.
"""

from __future__ import annotations

import re
import sys

from lendwise.catalog import REGISTRY
from lendwise.plans import formatted_plan, physical_plan
from lendwise.session import build_session
from lendwise.sources.projection import project

FEATURES = [
    ("hash exch", r"Exchange hashpartitioning"),
    ("range exch", r"Exchange rangepartitioning"),
    ("single exch", r"Exchange SinglePartition"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("BNLJ", r"BroadcastNestedLoopJoin"),
    ("Cartesian", r"CartesianProduct"),
    ("window", r"\bWindow\b"),
    ("scans", r"FileScan parquet"),
]


def summarize(df) -> dict:
    p = physical_plan(df)
    out = {name: len(re.findall(rx, p)) for name, rx in FEATURES}
    f = formatted_plan(df)
    out["pushed"] = len([x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", f) if x.strip()])
    return out


def main(sf_dir: str) -> None:
    spark = build_session("local[8]")
    t = project(spark, sf_dir)
    names = [n for n, _ in FEATURES] + ["pushed"]
    print("| key | " + " | ".join(names) + " |")
    print("|---" * (len(names) + 1) + "|")
    for key, fn in REGISTRY.items():
        s = summarize(fn(t))
        print(f"| {key} | " + " | ".join(str(s[n]) for n in names) + " |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
