"""``python -m tideglass``: list the queries, run one over a folder of tables, or print its SQL."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tideglass.plans import registry
from tideglass.session import prepare


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideglass")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="a Parquet folder to write; without it the first rows are printed")
    run.add_argument("--rows", type=int, default=20)
    sql = commands.add_parser("sql")
    sql.add_argument("name", choices=sorted(registry.ORACLES))
    given = parser.parse_args(argv)
    if given.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
    elif given.command == "sql":
        print(registry.ORACLES[given.name])
    else:
        spark = prepare(SparkSession.builder.appName("tideglass").getOrCreate())
        result = registry.QUERIES[given.name](spark, given.folder)
        if given.out:
            result.write.mode("overwrite").parquet(given.out)
        else:
            result.show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
