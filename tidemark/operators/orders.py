"""A date-driven trading rule and its order ledger."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .position import _same, ahead, blocks, with_position

HOLD, BUY, SELL = 0, 1, 2
# Fixed values of the market rule.
SPREAD, PIP = 0.001, 0.0001


def signals(df: DataFrame, buys: Sequence[datetime], sells: Sequence[datetime], by: Sequence[str] = (), date: str = "date", name: str = "pos") -> DataFrame:
    """df with ``action``: buy or sell on the first row of each listed date, else hold; a date in both
    lists is a buy."""
    listed = df.filter(F.col(date).isin([*buys, *sells]))
    own = [f"_{c}" for c in by]
    firsts = listed.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)], F.col(date).alias("_date")).agg(F.min(name).alias("_pos"))
    rows = df.join(firsts, _same(by, own) & (F.col(name) == F.col("_pos")), "left")
    action = F.when(F.col("_pos").isNull(), HOLD).when(F.col("_date").isin([*buys]) if buys else F.lit(False), BUY).otherwise(SELL)
    return rows.select(*df.columns, action.cast("int").alias("action"))


def until_done(df: DataFrame, n_dates: int, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Rows of ``signals`` up to the one that ends the run: the row of the last signal, or the row after
    it if that signal opened an order; all rows while a date is left."""
    last = F.max(F.struct(name, (F.col("order_status") == 0).cast("long").alias("opened")))
    own = [f"_{c}" for c in by]
    ends = df.filter("action <> 0").groupBy(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)]).agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
    ends = ends.filter(F.col("_n") >= n_dates)
    joined = df.join(ends, _same(by, own), "left")
    return joined.filter(F.col("_n").isNull() | (F.col(name) <= F.col(f"_last.{name}") + F.col("_last.opened"))).select(*df.columns)


def account(df: DataFrame, orders: DataFrame, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """(by, balance, equity, num_closes): what the rule's account shows at the end of a run. df: the rows of
    the run, orders: their ledger."""
    last = df.groupBy(*by).agg(F.max_by(F.struct("balance", "equity"), name).alias("_last"))
    own = [f"_{c}" for c in by]
    closes = orders.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)]).agg(F.count("closed_at").alias("_n"))
    joined = last.join(closes, _same(by, own), "left")
    return joined.select(*by, "_last.balance", "_last.equity", F.coalesce("_n", F.lit(0)).alias("num_closes"))


def ledger(df: DataFrame, risk: float, leverage: float, by: Sequence[str] = (), spread: float = SPREAD, pip: float = PIP, name: str = "pos") -> DataFrame:
    """One row per opened order. Rows: ``action``, order_status, close, low, high, equity, balance.

    An order opens on a signal while the market is flat, and closes on the next flat row unless that
    row opens another one. ``balanced`` tells whether equity and balance agree at the close."""
    flat = with_position(df.filter("order_status = 0"), name, by=by, name="_flat")
    facts = F.struct(name, "action", "low", "high", "equity", "balance")
    rows = blocks(flat, 1, by, name="_flat").withColumn("_next", F.lead(facts).over(ahead(by, "_flat")))
    opened = rows.filter((F.col("own")) & (F.col("action") != HOLD))
    closed = F.col("_next").isNotNull() & (F.col("_next.action") == HOLD)
    pips = F.when(F.col("action") == BUY, F.col("_next.low") - F.col("close")).otherwise(F.col("close") - (F.col("_next.high") + spread)) / pip
    orders = opened.select(
        *by,
        F.col(name).alias("opened_at"),
        "action",
        F.col("close").alias("price"),
        (F.col("equity") * risk * leverage).alias("volume"),
        F.col("balance").alias("balance_before"),
        F.when(closed, F.col(f"_next.{name}")).alias("closed_at"),
        F.when(closed, pips).alias("pips"),
        F.when(closed, F.col("_next.equity") == F.col("_next.balance")).alias("balanced"),
    )
    return orders.withColumn("profit", F.col("pips") * pip * F.col("volume"))
