"""Runs queries of the catalogue: python -m spanforge list | show NAME DIR | run NAME DIR OUT | explain NAME DIR."""

from __future__ import annotations

import argparse
import sys

from .plans import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanforge", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name, more in (("show", ()), ("explain", ()), ("run", ("out",))):
        p = sub.add_parser(name)
        for a in ("name", "dir", *more):
            p.add_argument(a)
    args = parser.parse_args(argv)
    known = catalog.queries()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if args.name not in known:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    if args.command == "run" and args.out.rstrip("/") == args.dir.rstrip("/"):
        print("the output would overwrite the input", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = known[args.name](spark, args.dir)
    if args.command == "show":
        df.show(truncate=False)
    elif args.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("errorifexists").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
