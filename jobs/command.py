"""What the command lines of the jobs share: a config file whose entries options may replace."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(name: str, text: str, run: Callable, kinds: dict[str, Callable]) -> None:
    """Reads ``--config`` and an option for each of ``kinds``, and calls ``run`` with a session that it stops."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=text)
    parser.add_argument("--config", help="JSON file with any of the options below")
    for option, kind in kinds.items():
        parser.add_argument(f"--{option.replace('_', '-')}", dest=option, type=kind)
    given = vars(parser.parse_args())
    settings = {}
    if given["config"]:
        with open(given["config"], encoding="utf-8") as f:
            settings = json.load(f)
    settings |= {o: given[o] for o in kinds if given[o] is not None}
    if unknown := settings.keys() - kinds.keys():
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
