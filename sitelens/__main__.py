"""Command line: ``python -m sitelens template`` or ``python -m sitelens run config.json``."""

from __future__ import annotations

import argparse
from pathlib import Path


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sitelens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("template", help="print an empty configuration")
    run = commands.add_parser("run", help="run the configured study and write its tables and surfaces")
    run.add_argument("config")
    args = parser.parse_args(argv)
    from .plans import study

    if args.command == "template":
        print(study.template())
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sitelens").getOrCreate()
    config = study.StudyConfig.from_json(Path(args.config).read_text(encoding="utf-8"))
    stacks, climate, g, bands = study.period_stacks(spark, config)
    study.run_config(spark, config, stacks, g, bands, climate)


if __name__ == "__main__":
    main()
