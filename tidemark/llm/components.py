"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a group-by with partial aggregation and a join on the node; each round is written to
the shared folder, so lineage stays short. Links are never brought to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Link each node's neighbours to the least of them and the node. large star: all neighbours,
    the larger ones are linked; small star: neighbours that are not larger."""
    if both_ways:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if both_ways:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """(node, component): component is the least node that can be reached. Nodes without links and
    links of a node to itself give no row; null ends are ignored. keep: writes each round's links."""
    now = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    now = keep(now, "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = keep(_star(_star(now, True), False), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
