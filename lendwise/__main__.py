"""Command line: run or explain a registered key.

    python -m lendwise list
    python -m lendwise run KEY [--sf-dir DIR | --tables ROOT] [--rows N]
    python -m lendwise explain KEY [--sf-dir DIR | --tables ROOT]

``--sf-dir`` projects the driver's test tables onto the library schema; ``--tables`` reads stored library
tables (``<root>/<table>.parquet``). Under spark-submit the cluster's master and settings are used.
"""

from __future__ import annotations

import argparse

from lendwise.catalog import REGISTRY
from lendwise.plans import formatted_plan
from lendwise.session import build_session
from lendwise.sources.projection import project
from lendwise.sources.tables import load_tables


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m lendwise")
    ap.add_argument("command", choices=["list", "run", "explain"])
    ap.add_argument("key", nargs="?")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.001")
    ap.add_argument("--tables", default=None)
    ap.add_argument("--rows", type=int, default=20)
    args = ap.parse_args(argv)
    if args.command == "list":
        for key, fn in REGISTRY.items():
            print(f"{key:32s} {(fn.__doc__ or '').strip().splitlines()[0] if fn.__doc__ else ''}")
        return
    if args.key not in REGISTRY:
        ap.error(f"unknown key {args.key!r}; see 'list'")
    spark = build_session()
    t = load_tables(spark, args.tables) if args.tables else project(spark, args.sf_dir)
    df = REGISTRY[args.key](t)
    if args.command == "explain":
        print(formatted_plan(df))
    else:
        df.show(args.rows, truncate=60)
    spark.stop()


if __name__ == "__main__":
    main()
