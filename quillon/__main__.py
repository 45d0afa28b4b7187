"""``python -m quillon --config CONFIG [QUERY]``: runs a JSON query (a file, or standard input) and prints its rows."""

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quillon.plans.codec import from_json
from quillon.plans.compile import compile_query
from quillon.sources.catalog import Catalog
from quillon.sources.sink import write_rows


def main() -> None:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("--config", required=True, help="JSON file of tables")
    parser.add_argument("--explain", action="store_true", help="print the plan instead")
    parser.add_argument("query", nargs="?", help="JSON query file; standard input without it")
    args = parser.parse_args()
    query = from_json(Path(args.query).read_text() if args.query else sys.stdin.read())
    spark = SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = compile_query(query, Catalog.from_config(spark, Path(args.config).read_text()))
    if args.explain:
        df.explain("formatted")
    else:
        write_rows(df, sys.stdout)


if __name__ == "__main__":
    main()
