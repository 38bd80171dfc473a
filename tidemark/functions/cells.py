"""How text, dates and missing values become numbers. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts that count as numbers.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
INFINITE = r"^[+-]?inf(inity)?\z"
SPACE = " \t\n\r\f\v"
DAY_FIRST = "d/M/yyyy H:m"

_INF = float("inf")


def to_number(text: Column) -> Column:
    """Text to double; what isn't a number, and what overflows, becomes null. White space around
    it, exponents and written infinities are read; hexadecimal, digit groups and type suffixes aren't."""
    bare = F.btrim(text, F.lit(SPACE))
    value = bare.try_cast("double")
    sign = F.when(bare.startswith("-"), F.lit(-_INF)).otherwise(F.lit(_INF))
    return F.when(bare.rlike(NUMBER) & (F.abs(value) < _INF), value).when(F.lower(bare).rlike(INFINITE), sign)


def is_number(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return bare.rlike(NUMBER) | F.lower(bare).rlike(INFINITE)


def as_double(column: Column, kind: T.DataType, epoch: bool = False) -> Column:
    """A column of any kind as double. A timestamp is not a number; with ``epoch`` it becomes its
    nanoseconds since 1970, a missing one the least long."""
    if isinstance(kind, T.StringType):
        return to_number(column)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        if not epoch:
            raise ValueError("a timestamp column is not a number; drop it or ask for its epoch")
        nanos = F.unix_micros(column.cast("timestamp")) * 1000
        return F.coalesce(nanos, F.lit(-(1 << 63))).cast("double")
    return column.cast("double")


def fill_zero(column: Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(column, F.lit(None).cast("double")), F.lit(0.0))


def parse_timestamp(text: Column, form: str = DAY_FIRST) -> Column:
    """Text to timestamp without a zone; null where it doesn't have the form. It is read as UTC, so no
    hour is missing or doubled."""
    at = F.try_to_timestamp(F.concat(text, F.lit(" UTC")), F.lit(f"{form} VV"))
    seconds = (F.unix_micros(at).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def convert_type(value):
    """An option's text as int, else float, else as it is; None stays None."""
    for kind in (int, float):
        try:
            return kind(value)
        except (TypeError, ValueError):
            continue
    return value
