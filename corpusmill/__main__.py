"""``python -m corpusmill list`` names the queries; ``run NAME --data DIR [--out DIR]`` runs one."""

from __future__ import annotations

import argparse

from corpusmill import catalog
from corpusmill.session import local_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = local_session()
    result = catalog.queries()[args.name](spark, args.data)
    if args.out:
        result.write.parquet(args.out)
    else:
        result.show(20, truncate=80)


if __name__ == "__main__":
    main()
