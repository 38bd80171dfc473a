"""Queries of joins by time, streams, encoders, evolved networks and SQL functions, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import autoencoder, evolution, network, temporal, windows
from ..sources.scratch import materialise, shared_root
from ..streaming import ledger as ledger_stream_
from ..streaming import windows as stream_windows
from . import catalogue
from .catalogue import BUYS, BY_USER, ORDERED, SELLS, events, query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@query("""
    WITH e AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'error')
    SELECT l.event_id, r.event_id AS error_id, r.value AS error_value
    FROM events l ASOF LEFT JOIN e r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_error(spark, sf_dir):
    """Of a user's errors at the same time, between which the SQL leaves the choice open, the largest event_id counts."""
    rows = table(spark, sf_dir, "events")
    errors = rows.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    return temporal.asof_join(rows.select("event_id", "user_id", "ts"), errors, "ts", by=["user_id"], ties=["error_id"]).select("event_id", "error_id", "error_value")


@query("""
    WITH d AS (SELECT o_orderdate, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_shipdate, d.o_orderdate, d.n, d.total FROM lineitem ASOF LEFT JOIN d ON l_shipdate > o_orderdate""")
def asof_order_day(spark, sf_dir):
    """One series for all rows: the last day of orders before each shipment."""
    days = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return temporal.asof_join(rows, days, "l_shipdate", "o_orderdate", exact=False)


@query("""
    SELECT l.event_id, r.event_id AS next_id, epoch_us(r.ts) - epoch_us(l.ts) AS gap
    FROM (SELECT * FROM events WHERE event_type = 'view') l ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.ts <= r.ts
    WHERE epoch_us(r.ts) - epoch_us(l.ts) <= 3600000000""")
def asof_next_purchase(spark, sf_dir):
    """Of purchases at the same time, between which the SQL leaves the choice open, the least event_id counts."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    views = rows.filter("event_type = 'view'").select("event_id", "at")
    bought = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("next_id"), F.col("at").alias("bought"))
    near = F.col("bought") - F.col("at") <= 3_600_000_000
    found = temporal.asof_join(views, bought, "at", "bought", direction="forward", ties=["next_id"], tolerance=near, how="inner")
    return found.select("event_id", "next_id", (F.col("bought") - F.col("at")).alias("gap"))


@query("""
    SELECT e.event_id AS error_id, o.event_id
    FROM (SELECT * FROM events WHERE event_type = 'error') e JOIN events o
    ON epoch_us(o.ts) BETWEEN epoch_us(e.ts) AND epoch_us(e.ts) + (e.event_id % 40) * 60000000""")
def interval_after_error(spark, sf_dir):
    """Events within up to forty minutes after an error; every fortieth error has no length."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = rows.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("begin"), (F.col("at") + F.col("event_id") % 40 * 60_000_000).alias("end"))
    return temporal.interval_join(spans, rows.select("event_id", "at"), ("begin", "end"), ("at", "at")).select("error_id", "event_id")


_SPAN = "epoch_us({0}.o_orderdate) + CASE WHEN {0}.o_orderkey % 50 = 0 THEN 900 ELSE {0}.o_orderkey % 20 END * 86400000000"


@query(f"""
    SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
    AND epoch_us(a.o_orderdate) <= {_SPAN.format('b')} AND epoch_us(b.o_orderdate) <= {_SPAN.format('a')}""")
def interval_open_orders(spark, sf_dir):
    """Orders of a customer that are open at the same time; one in fifty is open for 900 days."""
    day = 86_400_000_000
    begin = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    end = begin + F.when(F.col("o_orderkey") % 50 == 0, 900).otherwise(F.col("o_orderkey") % 20) * day
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", begin.alias("begin"), end.alias("end"))
    other = rows.withColumnsRenamed({"o_orderkey": "other_key"})
    return temporal.interval_join(rows, other, ("begin", "end"), ("begin", "end"), by=["o_custkey"]).filter("o_orderkey < other_key").select("o_custkey", "o_orderkey", "other_key")


@query(catalogue.ORACLE_SQL["order_ledger"])
def ledger_stream(spark, sf_dir):
    """The order ledger from three micro-batches, each a run of its own that goes on from the last one's
    checkpoint; what is open in the end is read from the state."""
    folder = _folder(spark, "ledger")
    market = materialise(catalogue._market(spark, sf_dir).drop("action").withColumn("key", F.lit("all")).select("key", *ledger_stream_.COLUMNS), "market")
    n = market.count()
    for k in range(3):
        part = market.filter((F.col("pos") >= k * n // 3) & (F.col("pos") < (k + 1) * n // 3))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(market.schema).parquet(f"{folder}/in")
        closed = ledger_stream_.ledger(stream, BUYS, SELLS, 0.1, 100)
        stream_windows.write(closed, f"{folder}/out", f"{folder}/state")
    done = spark.read.schema(f"key string, {ledger_stream_.ORDER}").parquet(f"{folder}/out").drop("key")
    left = ledger_stream_.open_orders(spark, f"{folder}/state").drop("key")
    rounded = {"volume": F.round("volume", 4), "pips": F.round("pips", 3), "profit": F.round("profit", 4)}
    return done.unionByName(left, allowMissingColumns=True).withColumns(rounded).select("opened_at", "action", "price", "volume", "closed_at", "pips", "balanced", "profit")


def _in_two(spark: SparkSession, sf_dir: str, folder: str, closed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``closed`` makes of events as a stream of two parts: those of the first twenty days but for every
    seventh event of user numbers that five divides, then the rest, late ones too."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first = (F.col("ts") < F.lit("2024-01-21").cast("timestamp")) & ~((F.col("user_id") % 5 == 0) & (F.col("event_id") % 7 == 0))
    for part in (rows.filter(first), rows.filter(~first)):
        part.write.mode("append").parquet(f"{folder}/in")
        found = closed(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        stream_windows.write(found, f"{folder}/out", f"{folder}/state")
    out = spark.read.schema(found.schema).parquet(f"{folder}/out")
    plain = [F.col(c).cast("timestamp_ntz").alias(f"window_{c}") for c in ("start", "end")]
    return out.select("user_id", *plain, "n", F.round("total", 4).alias("total"))


# a row of the second part is late if its window has ended by the first part's watermark
_PARTS = """ev AS (SELECT *, ts < TIMESTAMP '2024-01-21' AND NOT (user_id % 5 = 0 AND event_id % 7 = 0) AS first FROM events),
    mark AS (SELECT max(ts) FILTER (WHERE first) - INTERVAL 1 DAY AS before, max(ts) - INTERVAL 1 DAY AS upto FROM ev)"""


@query(f"""
    WITH {_PARTS}, placed AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM ev, mark)
    SELECT user_id, start AS window_start, start + INTERVAL 6 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM placed
    WHERE start + INTERVAL 6 HOUR <= upto AND (first OR start + INTERVAL 6 HOUR > before) GROUP BY user_id, start""")
def closed_windows(spark, sf_dir):
    sums = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    return _in_two(spark, sf_dir, _folder(spark, "closed"), lambda s: stream_windows.fixed(s, "ts", "6 hours", "1 day", sums, ["user_id"]))


def _sessions_sql(rows: str) -> str:
    """Sessions of rows (user_id, ts, value), each row with what its session is."""
    return f"""SELECT *, min(ts) OVER s AS window_start, max(ts) OVER s + INTERVAL 8 HOUR AS window_end, count(*) OVER s AS n, sum(value) OVER s AS sum FROM (
        SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (
            SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 8 HOUR, true) AS new FROM {rows}))
        WINDOW s AS (PARTITION BY user_id, k)"""


# sessions that the first part has closed stay as they are, whatever comes near them
@query(f"""
    WITH {_PARTS}, early AS (SELECT * EXCLUDE (new, k) FROM ({_sessions_sql("(SELECT user_id, ts, value FROM ev WHERE first)")})),
    gone AS (SELECT early.* FROM early, mark WHERE window_end <= before),
    rest AS (
        SELECT user_id, ts, value FROM early, mark WHERE window_end > before
        UNION ALL SELECT user_id, ts, value FROM ev, mark WHERE NOT first AND ts + INTERVAL 8 HOUR > before),
    late AS (SELECT l.* EXCLUDE (new, k) FROM ({_sessions_sql("rest")}) l, mark WHERE window_end <= upto)
    SELECT DISTINCT user_id, window_start, window_end, n, round(sum, 4) AS total FROM (SELECT * FROM gone UNION ALL SELECT * FROM late)""")
def closed_sessions(spark, sf_dir):
    """Sessions of users; late are rows whose own session, had they been alone, would have been closed. What has
    been given out takes no more rows."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    return _in_two(spark, sf_dir, _folder(spark, "sessions"), lambda s: stream_windows.sessions(s, "ts", "8 hours", "1 day", sums, ["user_id"]))


_RNG = np.random.default_rng(8)
CODER = autoencoder.Autoencoder(
    [network.Layer(np.round(_RNG.uniform(-0.4, 0.4, (2, 5)), 2), np.array([0.1, -0.2]), "tanh")],
    [network.Layer(np.round(_RNG.uniform(-0.4, 0.4, (5, 2)), 2), np.round(_RNG.uniform(-0.1, 0.1, 5), 2), "none")],
)


def _coder_sql() -> str:
    unit = lambda w, b, of: " + ".join(f"({float(x)}) * {of}[{i}]" for i, x in enumerate(w, 1)) + f" + ({float(b)})"
    (enc,), (dec,) = CODER.encoder, CODER.decoder
    code = ", ".join(f"tanh({unit(w, b, 'w')})" for w, b in zip(enc.weights, enc.bias, strict=True))
    back = ", ".join(unit(w, b, "c") for w, b in zip(dec.weights, dec.bias, strict=True))
    return f"""WITH {ORDERED}, held AS (SELECT pos, n, list(value / 500) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM ev),
        coded AS (SELECT pos, w, [{code}] AS c FROM held WHERE pos <= n - 5), decoded AS (SELECT pos, [{back}] AS d FROM coded),
        cells AS (SELECT pos + k - 1 AS pos, d[k] AS v FROM (SELECT pos, d, unnest(range(1, 6)) AS k FROM decoded))
        SELECT pos, round(avg(v), 9) AS output FROM cells GROUP BY pos"""


@query(_coder_sql())
def encoded_windows(spark, sf_dir):
    """Windows encoded, decoded and put together again, with fixed weights."""
    series = events(spark, sf_dir, "value").select("pos", (F.col("value") / 500).alias("v"))
    return autoencoder.reconstruct(series, CODER, "v").select("pos", F.round("output", 9).alias("output"))


@query()
def autoencoder_training(spark, sf_dir):
    held = windows.sliding_window(events(spark, sf_dir, "value").select("pos", (F.col("value") / 500).alias("v")), 8, "v")
    _, losses = autoencoder.fit(held, autoencoder.AutoencoderParams(interface=3, hidden=(8,), epochs=3, batches=2))
    return spark.createDataFrame(list(enumerate(losses)), "epoch long, mse double")


@query("""
    WITH x AS (SELECT value / 500 AS a, (user_id % 10) / 10 AS b, value / 500 AS y FROM events),
    g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS w0, CAST(embedding[2] AS DOUBLE) AS w1, CAST(embedding[3] AS DOUBLE) AS w2 FROM embeddings)
    SELECT vec_id AS genome_id, count(*) AS n, round(avg(abs(tanh(w0 * a + w1 * b + w2) - y)), 9) AS mae, round(avg(pow(tanh(w0 * a + w1 * b + w2) - y, 2)), 9) AS mse FROM g, x GROUP BY vec_id""")
def population_errors(spark, sf_dir):
    """Each vector is a genome whose first components are its weights; all are scored over the events in one plan."""
    rows = table(spark, sf_dir, "events").select(F.array(F.col("value") / 500, F.col("user_id") % 10 / 10).alias("state"), (F.col("value") / 500).alias("y"))
    genes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("genome_id"), F.posexplode(F.slice("embedding", 1, 3)).alias("innovation", "weight"))
    genes = genes.select("genome_id", F.col("innovation").cast("long").alias("innovation"), F.col("innovation").cast("long").alias("src"), F.lit(3).cast("long").alias("dst"), F.lit(0.0).alias("src_depth"), F.lit(1.0).alias("dst_depth"), F.col("weight").cast("double").alias("weight"), F.lit(True).alias("enabled"))
    found = evolution.errors(rows, genes, 2, 1)
    return found.select("genome_id", "n", F.round("mae", 9).alias("mae"), F.round("mse", 9).alias("mse"))


@query()
def evolution_training(spark, sf_dir):
    rows = events(spark, sf_dir, "value", "user_id")
    scaled = materialise(rows.select("pos", F.array(F.col("value") / 500, F.col("user_id") % 10 / 10).alias("state"), (F.col("value") / 500).alias("y")), "episode")
    _, curve = evolution.evolve(scaled, 2, 2, evolution.EvolutionParams(population=10))
    return spark.createDataFrame(list(enumerate(curve)), "generation long, fitness double")


def _view(df: DataFrame) -> str:
    name = f"rows_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


@query(f"""WITH {BY_USER}, held AS (SELECT user_id, pos, n, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM ev)
    SELECT user_id, pos, w[1] AS a, w[2] AS b, w[3] AS c FROM held WHERE pos <= n - 3""")
def sql_sliding_window(spark, sf_dir):
    tables.register(spark)
    name = _view(events(spark, sf_dir, "value", by=("user_id",)).select("user_id", "pos", "value"))
    return spark.sql(f"SELECT user_id, pos, w[0] AS a, w[1] AS b, w[2] AS c FROM sliding_window(TABLE({name}) PARTITION BY user_id ORDER BY (pos), 'value', 3)")


# over the root of two there are no ties to round, as hundredths times powers of 0.99 have
@query(f"WITH {BY_USER} SELECT event_id, round({catalogue._RETURN.format('PARTITION BY user_id ')} / sqrt(2), 5) AS scaled_return FROM ev")
def sql_discounted_return(spark, sf_dir):
    tables.register(spark)
    name = _view(events(spark, sf_dir, "value", by=("user_id",)).select("user_id", "event_id", "pos", "value"))
    return spark.sql(f"SELECT event_id, round(ret / sqrt(2), 5) AS scaled_return FROM discounted_return(TABLE({name}) PARTITION BY user_id ORDER BY (pos DESC), 'value', {catalogue.GAMMA})")


@query(catalogue.ORACLE_SQL["weight_entropy"])
def sql_weight_entropy(spark, sf_dir):
    tables.register(spark)
    name = _view(catalogue._genome(spark, sf_dir)[0])
    return spark.sql(f"SELECT genome_id, round(weight_entropy(weight, enabled), 8) AS entropy FROM {name} GROUP BY genome_id")
