"""Extension: the trading rule and its order ledger over a stream, with the open order and the dates done as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.orders import BUY, HOLD, PIP, SELL, SPREAD

ORDER = "opened_at long, action int, price double, volume double, balance_before double, closed_at long, pips double, balanced boolean, profit double"
OPEN = "opened_at long, action int, price double, volume double, balance_before double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ("pos", "date", "order_status", "close", "low", "high", "equity", "balance")


class _Rule(StatefulProcessor):
    """State of an account: the order that is open (a value), and the listed dates that it has met (a map)."""

    def __init__(self, buys: Sequence[int], risk: float, leverage: float, spread: float, pip: float):
        self.buys, self.risk, self.leverage, self.spread, self.pip = frozenset(buys), risk, leverage, spread, pip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN)
        self.done = handle.getMapState("done", "date long", "pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        # of a micro-batch only rows that can matter were let through; order is by pos within it
        batch = pd.concat(list(rows), ignore_index=True).sort_values("pos", kind="stable")
        now = self.open.get() if self.open.exists() else None
        found = []
        for r in batch.itertuples(index=False):
            action = HOLD
            if r.listed and not self.done.containsKey((int(r.day),)):
                self.done.updateValue((int(r.day),), (int(r.pos),))
                action = BUY if int(r.day) in self.buys else SELL
            if r.order_status != 0:
                continue
            if now is not None:
                found.append((*now, *(self._closed(now, r) if action == HOLD else (None, None, None, None))))
                now = None
            if action != HOLD:
                now = (int(r.pos), action, float(r.close), float(r.equity) * self.risk * self.leverage, float(r.balance))
        if now is not None:
            self.open.update(now)
        elif self.open.exists():
            self.open.clear()
        names = [c.split()[0] for c in ORDER.split(", ")]
        frame = pd.DataFrame(found, columns=names)
        for c in ("closed_at", "opened_at"):
            frame[c] = frame[c].astype("Int64")
        frame["action"] = frame["action"].astype("Int32")
        frame["balanced"] = frame["balanced"].astype("boolean")
        for c in ("price", "volume", "balance_before", "pips", "profit"):
            frame[c] = frame[c].astype("Float64")
        frame.insert(0, "key", pd.Series([key[0]] * len(frame), dtype=object))
        yield frame

    def _closed(self, order: tuple, r) -> tuple:
        _, action, price, volume, _ = order
        pips = (r.low - price if action == BUY else price - (r.high + self.spread)) / self.pip
        return int(r.pos), float(pips), bool(r.equity == r.balance), float(pips * self.pip * volume)

    def close(self) -> None:
        pass


def ledger(stream: DataFrame, buys: Sequence[datetime], sells: Sequence[datetime], risk: float, leverage: float, spread: float = SPREAD, pip: float = PIP) -> DataFrame:
    """Rows key, pos, date, order_status, close, low, high, equity, balance in; ``orders.ledger``'s rows out, with
    the key, when an order's fate is known: it closes, or another one takes its place. Orders that are
    still open are state, see ``open_orders``.

    A key's rows have to arrive in order of pos over micro-batches; within one they are sorted. Rows that are
    neither flat nor on a listed date are dropped before the shuffle, so a task holds of a key what else a
    micro-batch brings, which the source's own limits bound (maxFilesPerTrigger and the like). The first
    row of a listed date acts on it, whether or not the market is flat. Rows with a null key or date stay
    apart from others: a null key is an account of its own, a null date never acts."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what such state needs
    at = lambda d: F.unix_micros(F.lit(d).cast("timestamp_ntz").cast("timestamp"))
    listed = F.col("date").isin([*buys, *sells])
    rows = stream.select("key", *COLUMNS).withColumn("listed", F.coalesce(listed, F.lit(False))).filter("listed OR order_status = 0")
    day = F.unix_micros(F.col("date").cast("timestamp"))
    numbers = [F.col(c).cast("double") for c in ("close", "low", "high", "equity", "balance")]
    rows = rows.select("key", F.col("pos").cast("long"), F.coalesce(day, F.lit(0)).alias("day"), "listed", F.col("order_status").cast("int"), *numbers)
    kept = stream.sparkSession.range(1).select(F.array(*[at(d) for d in buys]).alias("d")).first().d if buys else []
    return rows.groupBy("key").transformWithStateInPandas(_Rule(kept, risk, leverage, spread, pip), f"key string, {ORDER}", "Append", "None")


def open_orders(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key and what is known of the orders that a stopped stream has left open, from its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(F.col("key").getField("key").alias("key"), "value.*")
