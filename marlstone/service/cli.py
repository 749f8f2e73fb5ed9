"""``python -m marlstone serve`` runs the REST service; ``inspect PATH`` describes a column file, ``validate URL`` checks a server."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from marlstone.operators import metrics
from marlstone.plans.engine import Engine
from marlstone.service.server import server
from marlstone.service.validate import Validator
from marlstone.sources import storage
from marlstone.sources.catalog import Catalog
from marlstone.types import ROW, project_supported


def session() -> SparkSession:
    return SparkSession.builder.appName("marlstone").config("spark.sql.caseSensitive", "true").getOrCreate()


def inspect(spark: SparkSession, path: str) -> str:
    df = project_supported(storage.read(spark, path).drop(ROW))
    details = "\n".join(f"  {r['column_name']}: {r['column_type']}, {r['row_count']} rows" for r in metrics.column_details(df).collect())
    return f"{metrics.report(df)}\ncolumns in detail\n{details}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("marlstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    serve = commands.add_parser("serve")
    serve.add_argument("-p", "--port", type=int, default=3000)
    serve.add_argument("-d", "--data-dir", default="./marlstone_data")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--ingest-root", help="only files below this folder may be loaded")
    commands.add_parser("inspect").add_argument("path")
    validate = commands.add_parser("validate", help="check a running server against its description")
    validate.add_argument("url", nargs="?", default="http://127.0.0.1:3000")
    validate.add_argument("--csv", help="a file the server can read, of a number and a text in each row")
    options = parser.parse_args(argv)
    if options.command == "validate":
        check = Validator(options.url)
        problems = check.run(options.csv)
        print("\n".join([*problems, f"{check.checks} requests, {len(problems)} problems"]))
        return int(bool(problems))
    spark = session()
    if options.command == "inspect":
        try:
            print(inspect(spark, options.path))
        except (PySparkException, ValueError) as e:
            print(f"{options.path}: {e}", file=sys.stderr)
            return 1
        return 0
    with server(Engine(spark, Catalog(spark, options.data_dir), ingest_root=options.ingest_root), options.port, options.host) as http:
        http.serve_forever()
    return 0
