"""From files to aligned, coerced and split frames."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import as_double, fill_zero
from ..operators import position
from ..sources.series import Series, read_series

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Prepared:
    train: DataFrame  # pos, state, y, targets, part
    validation: DataFrame | None  # pos, state, y, targets
    inputs: int


def target(x: Series, choice: int | None, y: Series | None) -> DataFrame:
    """(pos, y, targets): the columns of a file of its own, or a column of x by ordinal. targets holds all
    of them, y the first, which rewards and errors look at."""
    if y is not None:
        columns, frame = [c for c in y.columns if c != y.date], y.frame
        if not columns:
            raise ValueError("the target's file has no column but the date")
    elif isinstance(choice, int) and not isinstance(choice, bool):
        columns, frame = [x.columns[choice]], x.frame
    else:
        raise ValueError("the target is a file or the number of a column")
    cells = [fill_zero(as_double(F.col(c), frame.schema[c].dataType)) for c in columns]
    return frame.select("pos", cells[0].alias("y"), F.array(*cells).alias("targets"))


def states(x: Series) -> tuple[DataFrame, int]:
    """(pos, state): all columns but the date as one array, missing values 0."""
    columns = [c for c in x.columns if c != x.date]
    cells = [fill_zero(as_double(F.col(c), x.frame.schema[c].dataType)) for c in columns]
    return x.frame.select("pos", F.array(*cells).alias("state")), len(columns)


def prepare(spark: SparkSession, config: dict) -> Prepared:
    read = lambda key: read_series(spark, config[key], config["headers"], multiline=config.get("multiline", False))
    x = read("x_train_file")
    y = target(x, config.get("target_column"), read("y_train_file") if config.get("y_train_file") else None)
    features, inputs = states(x)
    train = position.align(features, y, config["input_offset"])
    train = position.split_thirds(train)
    log.info("rows by part: %s", position.check_parts(train))
    validation = None
    if config.get("x_validation_file") and config.get("y_validation_file"):
        xv, yv = read("x_validation_file"), read("y_validation_file")
        validation = position.align(states(xv)[0], target(xv, None, yv), config["input_offset"], strict=True)
    return Prepared(train, validation, inputs)


# What the trading rule looks at in a row.
MARKET = ("close", "low", "high", "order_status", "equity", "balance")
FLAT = {"order_status": 0.0, "equity": 10_000.0, "balance": 10_000.0}


def market(spark: SparkSession, config: dict) -> DataFrame:
    """(pos, date, close, low, high, order_status, equity, balance) of x's rows. The first column is the date;
    prices must be there, a missing account is one that never changes and is always flat."""
    x = read_series(spark, config["x_train_file"], config["headers"], multiline=config.get("multiline", False))
    if x.date is None:
        raise ValueError("the rule trades by dates, and the first column of x is none")
    names = {c.lower(): c for c in x.columns}
    missing = [c for c in MARKET if c not in names and c not in FLAT]
    if missing:
        raise ValueError(f"x has no column {', '.join(missing)}")
    cell = lambda c: fill_zero(as_double(F.col(names[c]), x.frame.schema[names[c]].dataType)) if c in names else F.lit(FLAT[c])
    return x.frame.select("pos", F.col(x.date).alias("date"), *[cell(c).alias(c) for c in MARKET])
