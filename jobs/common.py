"""What the jobs share: their command line, a small configuration file, logs, settings for the time of a call."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


@contextmanager
def settings(spark: SparkSession, **wanted: str | int) -> Iterator[None]:
    """Settings (with ``__`` for dots) that hold inside the block only."""
    names = {k.replace("__", "."): str(v) for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def main(run: Callable[..., dict], name: str, options: list[str], argv: list[str] | None = None) -> dict:
    """Reads the configuration file, lets the command line override it, and runs the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file with the options below")
    for option in options:
        parser.add_argument(f"--{option.replace('_', '-')}", help="overrides the file")
    given = vars(parser.parse_args(argv))
    config = json.loads(Path(given.pop("config")).read_text(encoding="utf-8"))
    if unknown := sorted(set(config) - set(options)):
        parser.error(f"unknown options in the file: {', '.join(unknown)}")
    config |= {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, **config)
    finally:
        spark.stop()
