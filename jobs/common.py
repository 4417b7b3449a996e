"""What the jobs' command lines share: configuration, session, log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object from a file on any file system that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main(name: str, run: Callable[..., object], paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """``run(spark, **paths, **config)`` in a session of its own; only here is one started and stopped."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", help="JSON file with the job's settings")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = given.pop("config")
        run(spark, **given, **(read_config(spark, config) if config else {}))
    finally:
        spark.stop()
