"""Errors, fitness, scaling and information of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import as_double
from ..functions.numeric import inverse, unit_bin


def errors(df: DataFrame, actual: str | Column, predicted: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, mse and fitness (1/mae, infinite for a perfect forecast), in one pass."""
    actual = F.col(actual) if isinstance(actual, str) else actual
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    gap = actual - predicted
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))
    return found.withColumn("fitness", inverse(F.col("mae")))


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Least and largest value of each column, in one pass; NaN in a column makes both NaN."""
    nan = float("nan")
    doubles = {c: as_double(F.col(c), df.schema[c].dataType) for c in columns}
    row = df.agg(*[f(doubles[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        out[c] = (nan, nan) if hi is not None and hi != hi else (lo, hi)  # Spark orders NaN last
    return out


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Columns scaled to [0, 1] by their ranges, which are one row and enter the plan as values. None
    if any column is constant or has no value."""
    found = ranges(df, columns) if columns else {}
    if any(lo is None or hi - lo == 0 for lo, hi in found.values()) or not found:
        return None
    scaled = {c: (as_double(F.col(c), df.schema[c].dataType) - lo) / F.lit(hi - lo) for c, (lo, hi) in found.items()}
    return df.withColumns(scaled)


def shannon_hartley(df: DataFrame, columns: Sequence[str], period_minutes: float = 60) -> DataFrame:
    """One row, ``bits``: N log2(1 + (mean/std)^2) over all N scaled cells. Rate and duration both hold the
    period, which cancels. Null for no columns or rows, a constant column, no spread, or period 0."""
    nothing = df.sparkSession.createDataFrame([(None,)], "bits double")
    scaled = min_max(df, columns) if period_minutes else None
    if scaled is None:
        return nothing
    cells = scaled.select(F.explode(F.array(*columns)).alias("v"))
    facts = cells.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    ratio = F.col("mean") / F.nullif("std", F.lit(0.0))
    return facts.select((F.col("n") * F.log2(F.lit(1.0) + ratio * ratio)).alias("bits"))


def histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin of values in [0, 1]; bins without values have no row."""
    return df.groupBy(*by, unit_bin(F.col(column), bins).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy(binned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """entropy in bits of counts ``n``, from sums alone: log2 N - sum(n log2 n) / N."""
    total = F.sum("n")
    return binned.groupBy(*by).agg((F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total).alias("entropy"))


def coerced_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each text column, its cells that don't become numbers, missing ones too."""
    return df.agg(*[F.count_if(as_double(F.col(c), df.schema[c].dataType).isNull()).alias(c) for c in columns])


def uniform_length(df: DataFrame, array: str) -> DataFrame:
    """One row: n, the least and largest length, and whether they agree."""
    found = df.agg(F.count(array).alias("n"), F.min(F.size(array)).cast("long").alias("shortest"), F.max(F.size(array)).cast("long").alias("longest"))
    return found.withColumn("uniform", F.col("shortest") == F.col("longest"))
