"""Operators as functions of SQL: ``register`` makes them known to a session.

    SELECT * FROM sliding_window(TABLE(t) PARTITION BY user_id ORDER BY (pos), 'value', 3)
    SELECT * FROM discounted_return(TABLE(t) PARTITION BY user_id ORDER BY (pos DESC), 'value', 0.99D)
    SELECT genome_id, weight_entropy(weight, enabled) FROM connections GROUP BY genome_id

The table functions give the columns of their table and more, so their result's type is that of the call. They
read a partition once, in its order, and hold a window's rows or one number of it; a partition is one task's
work, though, while the DataFrame forms (``operators.windows``) also cut a long one over many tasks. The
aggregate holds a group's weights, eight bytes each, as a genome is a model's own size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult


def _column(table: AnalyzeArgument, name: AnalyzeArgument | None, what: str) -> T.StructField:
    """The table's column that a text argument names."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    if name is None or not name.isConstantExpression or not isinstance(name.value, str):
        raise ValueError(f"the {what} is the name of a column, as text")
    found = [f for f in table.dataType.fields if f.name.lower() == name.value.lower()]
    if not found:
        raise ValueError(f"the table has no column {name.value}")
    return found[0]


def _number(argument: AnalyzeArgument, what: str, kinds: tuple) -> float:
    if not argument.isConstantExpression or isinstance(argument.value, bool) or not isinstance(argument.value, kinds):
        raise ValueError(f"the {what} is a constant number")
    return argument.value


def _with(table: AnalyzeArgument, name: str, kind: T.DataType) -> AnalyzeResult:
    if name in (f.name.lower() for f in table.dataType.fields):
        raise ValueError(f"the table has a column {name} already")
    return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField(name, kind)]))


class SlidingWindow:
    """The rows of a partition from which on it has ``size`` rows, with these rows' values as array ``w``."""

    def __init__(self) -> None:
        self.held: deque = deque()

    @staticmethod
    def analyze(table: AnalyzeArgument, value: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        field = _column(table, value, "value")
        if _number(size, "size", (int,)) < 1:
            raise ValueError("a window has at least one row")
        return _with(table, "w", T.ArrayType(field.dataType))

    def eval(self, row, value: str, size: int) -> Iterator[tuple]:
        self.held.append(row)
        if len(self.held) == size:
            yield (*self.held[0], [_cell(r, value) for r in self.held])
            self.held.popleft()

    def terminate(self) -> Iterator[tuple]:
        self.held.clear()
        return iter(())


class DiscountedReturn:
    """The rows of a partition, the last one first, with ``ret``: the row's reward and gamma times the return of
    the row before in that order. Missing rewards count as 0."""

    def __init__(self) -> None:
        self.ret = 0.0

    @staticmethod
    def analyze(table: AnalyzeArgument, reward: AnalyzeArgument, gamma: AnalyzeArgument) -> AnalyzeResult:
        field = _column(table, reward, "reward")
        if not isinstance(field.dataType, T.NumericType):
            raise ValueError(f"the column {field.name} holds no numbers")
        from decimal import Decimal

        _number(gamma, "gamma", (int, float, Decimal))
        return _with(table, "ret", T.DoubleType())

    def eval(self, row, reward: str, gamma: float) -> Iterator[tuple]:
        self.ret = float(_cell(row, reward) or 0.0) + float(gamma) * self.ret
        yield (*row, self.ret)

    def terminate(self) -> Iterator[tuple]:
        self.ret = 0.0
        return iter(())


def _cell(row, name: str):
    """A row's value by a name in any case."""
    try:
        return row[name]
    except ValueError:
        return row[next(f for f in row.__fields__ if f.lower() == name.lower())]


@F.pandas_udf(T.DoubleType())
def weight_entropy(weight: pd.Series, enabled: pd.Series) -> float:
    """Entropy of a group's enabled weights in 50 bins between the least and the greatest; 0 without any or
    without spread. Null weights don't count, nor do rows whose ``enabled`` is null."""
    w = weight[enabled.fillna(False).astype(bool)].dropna().to_numpy(float)
    if not len(w) or w.min() == w.max():
        return 0.0
    scaled = (w - w.min()) / (w.max() - w.min())
    counts = np.histogram(scaled, 50, (0.0, 1.0))[0]
    p = counts[counts > 0] / len(w)
    return float(-(p * np.log2(p)).sum())


def register(spark: SparkSession) -> None:
    """sliding_window, discounted_return and weight_entropy in the session's SQL."""
    spark.udtf.register("sliding_window", F.udtf(SlidingWindow))
    spark.udtf.register("discounted_return", F.udtf(DiscountedReturn))
    spark.udf.register("weight_entropy", weight_entropy)
