"""Extension: windows of event time over a stream, given out once they are closed.

The watermark trails the latest event time seen by ``delay``. A window is closed, and given out in append
mode, when the watermark has passed its end; a row is late, and counts nowhere, if every window it falls into
was closed when its micro-batch began. So each window comes once and never changes. Rows without a time count
nowhere either. State is a row for each open window and key, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _aggregated(stream: DataFrame, window: Column, time: str, delay: str, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    rows = stream.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    found = rows.groupBy(window.alias("_window"), *by).agg(*aggregates)
    kept = [c for c in found.columns if c not in (*by, "_window")]
    return found.select(*by, F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *kept)


def fixed(stream: DataFrame, time: str, width: str, delay: str, aggregates: Sequence[Column], by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """(by, start, end, aggregates) of windows of one width, each ``slide`` (or width) after the one before."""
    return _aggregated(stream, F.window(time, width, slide), time, delay, by, aggregates)


def sessions(stream: DataFrame, time: str, gap: str, delay: str, aggregates: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """(by, start, end, aggregates) of runs of rows of a key that are less than ``gap`` apart; end is ``gap`` after
    the last row. A row is late by its own ``gap``, as if it were alone; one that isn't, but lies near a session
    that has been given out, begins another."""
    return _aggregated(stream, F.session_window(time, gap), time, delay, by, aggregates)


def write(closed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that the source has now, as far as the windows are closed by then; a later call with the same
    checkpoint goes on from there."""
    sink = closed.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that the batches of a query have dropped as late, as its state operators count them: once for each
    key and window that rows of a task would have gone to."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
