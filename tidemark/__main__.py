"""python -m tidemark: train and evaluate, or score a saved policy.

The log goes to standard output and to tidemark.log, or the file that TIDEMARK_LOG names (none if empty).
"""

from __future__ import annotations

import logging
import os
import sys
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession

from . import config as options
from . import registry
from .plans import run
from .sources import settings

log = logging.getLogger("tidemark")


def start_log(path: str | None = None, level: int = logging.INFO) -> None:
    """To standard output and, if wanted, a file that is turned over; a second call adds nothing."""
    if log.handlers:
        return
    log.setLevel(level)
    for handler in (logging.StreamHandler(sys.stdout), *([RotatingFileHandler(path, maxBytes=5_000_000, backupCount=3)] if path else [])):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)


def configure(argv: list[str]) -> dict:
    given, rest = options.parser().parse_known_args(argv)
    given = vars(given)
    unknown, positional = options.unknown_options(rest)
    secret = [given.get(k) for k in options.SECRET]
    files: dict = {}
    if given.get("remote_load_config"):
        files |= settings.remote_load_config(given["remote_load_config"], *secret)
    if given.get("load_config"):
        files |= settings.load_config(given["load_config"])
    chosen = options.DEFAULTS | files | unknown | given
    params: dict = {}
    for group in registry.GROUPS:
        params |= registry.get_plugin_params(group, chosen[f"{group.removesuffix('s')}_plugin"])
    for key in options.UNUSED:
        if key in files | given:
            log.warning("option %s has no effect", key)
    return options.merge(options.DEFAULTS, params, files, unknown, given, positional)


def main(argv: list[str] | None = None) -> int:
    start_log(os.environ.get("TIDEMARK_LOG", "tidemark.log"))
    try:
        config = configure(sys.argv[1:] if argv is None else argv)
        if not config["x_train_file"]:
            raise ValueError("x_train_file is missing")
        spark = SparkSession.builder.appName("tidemark").getOrCreate()
        if config["load_model"]:
            run.score_saved(spark, config)
            return 0
        report = run.train_and_evaluate(spark, config)
        log.info("report: %s", report)
        settings.save_debug_info(report, config["save_log"])
        if config["remote_log"]:
            settings.remote_log(options.difference(config), report, config["remote_log"], config["username"], config["password"])
        settings.save_config(options.difference(config), config["save_config"])
        if config["remote_save_config"]:
            settings.remote_save_config(options.difference(config), config["remote_save_config"], config["username"], config["password"])
    except Exception:
        log.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
