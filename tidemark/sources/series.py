"""Series as CSV files: explicit coercion instead of inference, dates, positions, writing."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import DAY_FIRST, is_number, parse_timestamp, to_number
from ..operators.position import with_position

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Series:
    frame: DataFrame  # pos and the columns
    columns: list[str]
    date: str | None


def _columns(raw: DataFrame, headers: bool, form: str) -> tuple[list[str], str | None, set[str]]:
    """(names, date column, numeric columns), from one pass over the cells."""
    tests = [F.bool_and(parse_timestamp(F.col(raw.columns[0]), form).isNotNull() | (F.col(raw.columns[0]) == ""))]
    tests += [F.bool_and(is_number(F.col(c))) for c in raw.columns]
    dated, *numeric = raw.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
    if headers:
        names = list(raw.columns)
    elif dated:
        names = ["date", *(f"col_{i}" for i in range(1, len(raw.columns)))]
    else:
        names = [f"col_{i}" for i in range(len(raw.columns))]
    found = {n for n, yes in zip(names, numeric, strict=True) if yes or not headers}
    return names, names[0] if dated else None, found


def read_series(spark: SparkSession, path: str, headers: bool = True, date_format: str = DAY_FIRST, multiline: bool = False) -> Series:
    """A CSV of comma-separated cells in file order.

    The first column is a date if all its cells have the form. Without headers every other column is
    coerced to double, bad cells to null, and names are generated; with headers the columns whose cells
    are all numbers become doubles and the rest stays text. A missing file and a malformed one raise.

    multiline: cells in quotes may hold line breaks and doubled quotes. A file is then one task's work."""
    options = {"header": headers} | ({"multiLine": True, "escape": '"'} if multiline else {})
    try:
        first = spark.read.options(**options).csv(path)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in first.columns])
        raw = spark.read.schema(schema).options(**options, mode="FAILFAST").csv(path)
    except AnalysisException:
        log.exception("can't read %s", path)
        raise
    names, date, numeric = _columns(raw, headers, date_format)
    place = ["_file", "_block", "_row"]
    at = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    cells = at.toDF(*names, *place)
    if date:
        cells = cells.withColumn(date, parse_timestamp(F.col(date), date_format))
    cells = cells.withColumns({c: to_number(F.col(c)) for c in names if c in numeric and c != date})
    return Series(with_position(cells, *place).select("pos", *names), names, date)


def write_series(series: DataFrame, path: str, include_date: bool = True, headers: bool = True, one_file: bool = False, date: str = "date", name: str = "pos", keep_name: bool = False) -> None:
    """CSV part files in the order of ``name``, which is left out unless keep_name; the date column only with
    include_date. ``one_file`` is for small results, as one task writes them all."""
    kept = [c for c in series.columns if (keep_name or c != name) and (include_date or c != date)]
    rows = series.orderBy(name).select(*kept)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", headers).option("escape", '"').csv(path)
