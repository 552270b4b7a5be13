"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

FORMAT = "%(asctime)s %(name)s %(levelname)s %(message)s"


def config_of(job: str, path: str | None = None) -> dict:
    """A job's settings: those of its own file, with those of another file in their place."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{job}.json"), encoding="utf-8") as f:
        config = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        unknown = sorted(set(given) - set(config))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        config |= given
    return config


def main(job: str, about: str, paths: dict[str, str], run: Callable) -> None:
    """Parses the paths and --config, creates a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help=f"a JSON file with settings that replace those of {job}.json")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format=FORMAT)
    config = config_of(job, given.pop("config"))
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **given, config=config)
    finally:
        spark.stop()
