"""What the jobs share: settings, logging, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file: one beside the driver, or, if the path names a file system, one that Spark reads."""
    if "://" in path:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path) as f:
        return json.load(f)


def table(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """The table at `path`, made empty if there is none. The schema is given, so partition values keep their type."""
    frame = spark.createDataFrame([], schema)
    frame.write.mode("ignore").partitionBy(*by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def command_line(run: Callable, description: str, paths: dict[str, str], default: str) -> None:
    """Parses path arguments and --config, runs the job in a session of its own, and stops that."""
    parser = argparse.ArgumentParser(description=description)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=default, help="JSON file of settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        run(spark, **{k: v for k, v in given.items() if k != "config"}, config=settings(spark, given["config"]))
    finally:
        spark.stop()
