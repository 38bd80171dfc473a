"""Sliding windows and their inverse, step-wise rewards, returns and trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import inverse
from ..sources.scratch import materialise
from .position import _same, ahead, blocks

RETURN_BLOCK = 512


def sliding_window(df: DataFrame, size: int, value: str, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """(by, row_id, w): the ``size`` values from each position on, where there are as many."""
    if size < 1:
        raise ValueError("a window has at least one row")
    span = ahead(by, name).rowsBetween(0, size - 1)
    held = blocks(df.select(*by, name, value), size - 1, by, name=name).withColumn("w", F.collect_list(F.struct(value)).over(span))
    full = held.filter(F.col("own") & (F.size("w") == size))
    return full.select(*by, F.col(name).alias("row_id"), F.transform("w", lambda s: s[value]).alias("w"))


def overlap_add(windows: DataFrame, mode: str = "coverage") -> DataFrame:
    """(pos, output): the series that overlapping windows (row_id, w) cover, each position divided by
    the number of windows on it (``coverage``) or by the older divisors (``compat``)."""
    cells = windows.select("row_id", F.posexplode("w").alias("lag", "v")).select((F.col("row_id") + F.col("lag")).alias("pos"), "v")
    if mode == "coverage":
        return cells.groupBy("pos").agg(F.avg("v").alias("output"))
    if mode != "compat":
        raise ValueError(f"unknown mode {mode}")
    facts = windows.agg(F.count(F.lit(1)), F.max(F.size("w"))).first()
    n, w, i = facts[0], facts[1] or 0, F.col("pos")
    one = F.lit(1)
    divisor = F.when(i < w - 2, i + 1).otherwise(one) * F.when((i >= w - 2) & (i < n), w).otherwise(one) * F.when(i >= n, n + w - i).otherwise(one)
    return cells.groupBy("pos").agg(F.sum("v").alias("s")).select("pos", (F.col("s") / divisor).alias("output"))


def episode(df: DataFrame, max_steps: int, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """(by, t, idx, done): steps 1 .. min(max_steps, n) and the row that each looks at; the last row is
    looked at again by a step past the end."""
    last = F.lead(F.lit(1)).over(ahead(by, name)).isNull()
    steps = blocks(df.select(*by, name), 1, by, name=name).withColumn("last", last).filter(F.col("own") & (F.col(name) < max_steps))
    t = F.col(name) + 1
    return steps.select(*by, t.alias("t"), F.when(F.col("last"), F.col(name)).otherwise(t).alias("idx"), (F.col("last") | (t == max_steps)).alias("done"))


def step_rewards(df: DataFrame, actual: str, predicted: str, max_steps: int | None = None, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """(by, pos, reward, done): the action at a row is scored against the row after it, the last one, and
    one before a missing value, against its own; 1/|gap|, infinite where it is 0."""
    over = ahead(by, name)
    rows = blocks(df.select(*by, name, actual, predicted), 1, by, name=name)
    rows = rows.withColumn("_next", F.lead(actual, 1).over(over)).withColumn("_last", F.lead(F.lit(1)).over(over).isNull()).filter("own")
    seen = F.coalesce(F.col("_next"), F.col(actual))
    done = F.col("_last") if max_steps is None else F.col("_last") | (F.col(name) + 1 == max_steps)
    out = rows.select(*by, name, inverse(F.abs(seen - F.col(predicted))).alias("reward"), done.alias("done"))
    return out if max_steps is None else out.filter(F.col(name) < max_steps)


def value_rewards(df: DataFrame, actual: str, max_steps: int, name: str = "pos") -> DataFrame:
    """(pos, reward): the row's own value for each step before max_steps, 0 when done; actions don't count."""
    return df.filter(F.col(name) <= max_steps).select(name, F.when(F.col(name) < max_steps, F.col(actual)).otherwise(F.lit(0.0)).alias("reward"))


def _carried(heads: DataFrame, by: Sequence[str], last: int) -> DataFrame:
    """(by, _b, carry): what blocks 0 .. last get from those after them, where a block turns x into
    a + c x. RETURN_BLOCK blocks are folded at a time, and these groups in turn by the same rule, so
    that no task holds more than RETURN_BLOCK rows of an episode."""

    grouped = heads.groupBy(*by, F.floor(F.col("_b") / RETURN_BLOCK).alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_b", "a", "c")), asc=False).alias("_s"))
    start = F.struct(F.lit(0.0).alias("held"), F.lit(1.0).alias("share"), F.expr("cast(array() as array<struct<_b:bigint,held:double,share:double>>)").alias("out"))

    def fold(acc, x):
        share = F.greatest(x["c"] * acc["share"], F.lit(5e-324))  # above 0, so that an infinite return stays one
        own = F.struct(x["_b"].alias("_b"), acc["held"].alias("held"), acc["share"].alias("share"))
        return F.struct((x["a"] + x["c"] * acc["held"]).alias("held"), share.alias("share"), F.array_append(acc["out"], own).alias("out"))

    found = grouped.select(*by, "_g", F.aggregate("_s", start, fold).alias("_f"))
    each = found.select(*by, "_g", F.col("_f.held").alias("a"), F.col("_f.share").alias("c"), F.explode("_f.out").alias("_o"))
    folded = each.select(*by, "_o._b", "_g", "a", "c", "_o.held", "_o.share")
    if last < RETURN_BLOCK:
        return folded.select(*by, "_b", F.col("held").alias("carry"))
    folded = materialise(folded, "folded")
    groups = folded.select(*by, F.col("_g").alias("_b"), "a", "c").distinct()
    own = [f"_{c}" for c in by]
    above = _carried(groups, by, last // RETURN_BLOCK).toDF(*own, "_h", "_x")
    joined = folded.join(above, _same(by, own) & (F.col("_g") == F.col("_h")))
    return joined.select(*by, "_b", (F.col("held") + F.col("share") * F.col("_x")).alias("carry"))


def discounted_return(df: DataFrame, gamma: float, reward: str = "reward", by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """df with ``ret``: G = r + gamma * (G of the next position). Missing rewards count as 0.

    Episodes are cut into blocks of RETURN_BLOCK steps, so that no task holds a long one and powers of
    gamma don't vanish; what a block passes back is carried over the blocks' heads alone."""
    b, k = F.floor(F.col(name) / RETURN_BLOCK), F.col(name) % RETURN_BLOCK
    power = F.pow(F.lit(float(gamma)), k.cast("double"))
    back = W.partitionBy(*by, "_b").orderBy(F.desc(name)).rowsBetween(W.unboundedPreceding, 0)
    r = F.coalesce(F.col(reward), F.lit(0.0))
    if gamma <= 0:
        return df.withColumn("ret", r)
    local = df.withColumn("_b", b).withColumn("ret", F.sum(r * power).over(back) / power)
    longest = df.agg(F.max(name)).first()[0]
    if longest is None or longest < RETURN_BLOCK:
        return local.drop("_b")
    power_of_block = F.pow(F.lit(float(gamma)), F.count(F.lit(1)).cast("double"))
    heads = local.groupBy(*by, "_b").agg(F.min_by("ret", name).alias("a"), power_of_block.alias("c"))
    own = [f"_{c}" for c in by]
    carried = _carried(heads, by, longest // RETURN_BLOCK).toDF(*own, "_c", "_carry")
    joined = local.join(carried, _same(by, own) & (F.col("_b") == F.col("_c")))
    to_end = F.pow(F.lit(float(gamma)), (F.lit(RETURN_BLOCK) - k).cast("double"))  # only the last block is shorter; it carries 0
    return joined.withColumn("ret", F.col("ret") + to_end * F.col("_carry")).select(*df.columns, "ret")


def advantage(df: DataFrame, value: str | Column = "value") -> DataFrame:
    """df with ``advantage``: return less value."""
    return df.withColumn("advantage", F.col("ret") - (F.col(value) if isinstance(value, str) else value))


def pad(df: DataFrame, steps: int, by: Sequence[str], name: str = "pos") -> DataFrame:
    """Trajectories shorter or longer than ``steps`` get their last row once more."""
    rest = [c for c in df.columns if c not in by and c != name]
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), name).alias("_row"), (F.max(name) + 1).alias(name)).filter(F.col(name) != steps)
    return df.unionByName(last.select(*by, name, *[F.col("_row")[c].alias(c) for c in rest]))
