"""Dense row positions, and what is done by position: skipping, aligning, splitting, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise

PARTS = ("train", "prune", "stabilize")
_ROW = (1 << 33) - 1


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def with_position(df: DataFrame, *order: str, by: Sequence[str] = (), name: str = "pos", nulls: str = "first") -> DataFrame:
    """df with the 0-based rank of each row in the given order (within each group of ``by``). nulls: whether
    rows with a null in a column of the order come ``first`` or ``last`` by it.

    One range shuffle, no window over the whole table: rows are numbered within sorted partitions,
    the sorted table is written once, and the partitions' sizes (a row each) give the offsets. Ties
    are numbered in the order in which they were written."""
    if nulls not in ("first", "last"):
        raise ValueError(f"unknown place of nulls {nulls}")
    keys = [*by, *[F.col(c).asc_nulls_last() if nulls == "last" else F.col(c) for c in order]]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = materialise(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    placed = placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW))).select(*df.columns, name)
    if not by:
        return placed
    own = [f"_{c}" for c in by]
    starts = placed.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)]).agg(F.min(name).alias("_start"))
    return placed.join(starts, _same(by, own)).withColumn(name, F.col(name) - F.col("_start")).select(*df.columns, name)


def skip(df: DataFrame, offset: int, name: str = "pos") -> DataFrame:
    """Without the first ``offset`` rows, positions from 0 again; a negative offset keeps the last ones."""
    first = offset if offset >= 0 else max(0, df.count() + offset)
    return df.filter(F.col(name) >= first).withColumn(name, F.col(name) - first) if first else df


def align(x: DataFrame, y: DataFrame, offset: int = 0, strict: bool = False, name: str = "pos") -> DataFrame:
    """Rows of x after ``offset``, each beside the row of y at its new position; the longer side is cut,
    or with ``strict`` unequal lengths raise."""
    x = skip(x, offset, name)
    if strict:
        check_equal_length(x, y)
    return x.join(y, name)


def check_equal_length(x: DataFrame, y: DataFrame) -> int:
    n, m = x.count(), y.count()
    if n != m:
        raise ValueError(f"x and y have different lengths: {n} and {m}")
    return n


def split_thirds(df: DataFrame, n: int | None = None, name: str = "pos") -> DataFrame:
    """df with ``part``: two thirds of n div 3 rows each by position, and the rest."""
    third = (df.count() if n is None else n) // 3
    part = F.when(F.col(name) < third, PARTS[0]).when(F.col(name) < 2 * third, PARTS[1]).otherwise(PARTS[2])
    return df.withColumn("part", part)


def check_parts(df: DataFrame, what: str = "x") -> dict[str, int]:
    """Rows of each part; an empty one raises."""
    found = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}  # three rows
    for part in PARTS:
        if not found.get(part):
            raise ValueError(f"{what}_{part}_data is empty.")
    return found


def blocks(df: DataFrame, reach: int, by: Sequence[str] = (), size: int = 1 << 16, name: str = "pos") -> DataFrame:
    """Every row in its block of ``size`` positions (own), and the first ``reach`` rows of a block also
    in the one before it: windows that look ahead then run within (by, block), whose size is bounded."""
    size = max(size, reach, 1)
    home = F.floor(F.col(name) / size)
    both = F.when((F.col(name) % size < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    return df.withColumn("block", F.explode(both)).withColumn("own", F.col("block") == home)


def ahead(by: Sequence[str] = (), name: str = "pos"):
    """Window over (by, block) in position order, for rows that ``blocks`` has dealt."""
    return W.partitionBy(*by, "block").orderBy(name)


def head(df: DataFrame, n: int = 5, name: str = "pos") -> DataFrame:
    return df.orderBy(name).limit(n)
