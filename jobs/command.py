"""What the jobs' command lines have in common: a configuration file, and options that override it."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def run_from_command_line(job: Callable[..., dict], name: str, about: str, argv: list[str] | None = None) -> None:
    """Run job(spark, **settings) in a session of its own. The settings are those of the JSON file, less or more those given as
    --set NAME=VALUE, whose value is JSON or else text."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    p.add_argument("config", help="JSON object of the job's settings, such as paths; any path that Spark reads")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="override a setting")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        settings = json.loads(spark.read.text(a.config, wholetext=True).first()[0])
        for name_, _, value in (x.partition("=") for x in a.set):
            try:
                settings[name_] = json.loads(value)
            except ValueError:
                settings[name_] = value
        job(spark, **settings)
    finally:
        spark.stop()
