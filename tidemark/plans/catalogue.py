"""Queries over the standard tables, one for each operator, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as options
from .. import training
from ..functions import numeric
from ..functions.cells import as_double, fill_zero, is_number, parse_timestamp, to_number
from ..functions.deflate import kolmogorov
from ..operators import genome, metrics, network, orders, position, windows
from ..sources.scratch import materialise, shared_root
from ..sources.series import read_series, write_series
from ..streaming import rewards

GAMMA = 0.99
FIRST_HOUR = datetime(2024, 1, 2)
BUYS = [FIRST_HOUR + timedelta(hours=14 * i) for i in range(20)]
SELLS = [FIRST_HOUR + timedelta(hours=14 * i + 5) for i in range(20)] + BUYS[:2]
WEIGHTS = np.random.default_rng(5)
NET = [
    network.Layer(np.round(WEIGHTS.uniform(-0.5, 0.5, (4, 64)), 3), np.round(WEIGHTS.uniform(-0.5, 0.5, 4), 3), "relu"),
    network.Layer(np.round(WEIGHTS.uniform(-0.5, 0.5, (1, 4)), 3), np.array([0.125]), "tanh"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    kept = dict.fromkeys([*by, "ts", "event_id", *columns])
    return position.with_position(table(spark, sf_dir, "events").select(*kept), "ts", "event_id", by=by, nulls="last")


ORDERED = "ev AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"
BY_USER = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
PART = "CASE WHEN pos < n // 3 THEN 'train' WHEN pos < 2 * (n // 3) THEN 'prune' ELSE 'stabilize' END"


@query(f"""
    WITH {ORDERED}, aligned AS (
        SELECT y.pos, x.value AS p, y.value AS y, count(*) OVER () AS n FROM ev x JOIN ev y ON x.pos - 5 = y.pos)
    SELECT {PART} AS part, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 4) AS mse,
           round(1 / avg(abs(y - p)), 8) AS fitness FROM aligned GROUP BY 1""")
def forecast_by_part(spark, sf_dir):
    rows = events(spark, sf_dir, "value").select("pos", "value")
    aligned = position.split_thirds(materialise(position.align(rows.withColumnRenamed("value", "p"), rows.withColumnRenamed("value", "y"), 5), "aligned"))
    found = metrics.errors(aligned, "y", "p", ["part"])
    return found.select("part", "n", F.round("mae", 6).alias("mae"), F.round("mse", 4).alias("mse"), F.round("fitness", 8).alias("fitness"))


@query(f"WITH {ORDERED} SELECT event_id, pos FROM ev")
def dense_position(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "pos")


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name,
                 CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation""")
def csv_roundtrip(spark, sf_dir):
    path = f"{shared_root(spark)}/tidemark/csv-{uuid.uuid4().hex}"
    write_series(position.with_position(table(spark, sf_dir, "nation"), "n_nationkey", nulls="last"), path)
    return read_series(spark, path).frame


@query("""SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, CAST(r_regionkey AS DOUBLE) AS col_0, CAST(NULL AS DOUBLE) AS col_1 FROM region""")
def csv_headerless(spark, sf_dir):
    path = f"{shared_root(spark)}/tidemark/csv-{uuid.uuid4().hex}"
    write_series(position.with_position(table(spark, sf_dir, "region"), "r_regionkey", nulls="last"), path, headers=False)
    return read_series(spark, path, headers=False).frame


@query(f"WITH {ORDERED} SELECT pos, date_trunc('minute', ts) AS date, value AS col_1 FROM ev")
def csv_dates(spark, sf_dir):
    path = f"{shared_root(spark)}/tidemark/csv-{uuid.uuid4().hex}"
    rows = events(spark, sf_dir, "value")
    write_series(rows.select("pos", F.date_format("ts", "d/M/yyyy H:m").alias("date"), "value"), path, headers=False)
    series = read_series(spark, path, headers=False)
    return series.frame.select("pos", F.col(series.date).alias("date"), "col_1")


@query("SELECT o_orderkey, date_trunc('minute', o_orderdate) AS read_at, o_orderkey % 3 <> 0 AS written FROM orders")
def date_cells(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    read = F.coalesce(parse_timestamp(text), parse_timestamp(text, "yyyy-MM-dd H:m"))
    return table(spark, sf_dir, "orders").select("o_orderkey", read.alias("read_at"), parse_timestamp(text).isNotNull().alias("written"))


@query("""SELECT doc_id, coalesce(try_cast(substr(source, 4) AS DOUBLE), 0) + coalesce(try_cast(lang AS DOUBLE), 0) AS filled FROM documents""")
def filled_cells(spark, sf_dir):
    number = lambda c: fill_zero(to_number(c))
    return table(spark, sf_dir, "documents").select("doc_id", (number(F.substring("source", 4, 100)) + number(F.col("lang"))).alias("filled"))


@query(f"WITH {ORDERED} SELECT {PART} AS part, count(*) AS n FROM ev GROUP BY 1")
def part_counts(spark, sf_dir):
    found = position.check_parts(position.split_thirds(events(spark, sf_dir)))
    return spark.createDataFrame(sorted(found.items()), "part string, n long")


_TOKEN = r"trim(w, E' \t\n\r\f\v')"


@query(rf"""
    WITH words AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents),
    seen AS (SELECT doc_id, regexp_matches({_TOKEN}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z') AS plain,
                    regexp_matches(lower({_TOKEN}), '^[+-]?inf(inity)?\z') AS endless, try_cast({_TOKEN} AS DOUBLE) AS v FROM words)
    SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE plain OR endless) AS n_written,
           count(*) FILTER (WHERE endless OR (plain AND abs(v) < 'infinity'::DOUBLE)) AS n_numbers,
           max(v) FILTER (WHERE plain AND abs(v) < 'infinity'::DOUBLE) AS largest FROM seen GROUP BY doc_id""")
def numeric_coerce(spark, sf_dir):
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("w")).withColumn("v", to_number(F.col("w")))
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(is_number(F.col("w"))).alias("n_written"), F.count("v").alias("n_numbers"), F.max(finite).alias("largest"))


@query("SELECT count(*) AS o_orderstatus, count(*) AS o_orderpriority FROM orders")
def coerced_cells(spark, sf_dir):
    return metrics.coerced_cells(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice FROM orders")
def target_by_ordinal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return position.with_position(rows, "o_orderkey", nulls="last").select("pos", rows.columns[3])


@query(f"WITH {ORDERED} SELECT y.pos, x.event_id, y.value FROM ev x JOIN ev y ON x.pos - 5 = y.pos")
def offset_align(spark, sf_dir):
    rows = events(spark, sf_dir, "value")
    return position.align(rows.select("pos", "event_id"), rows.select("pos", "value"), 5)


@query(f"WITH {ORDERED} SELECT event_id, pos - (n - 100) AS pos FROM ev WHERE pos >= n - 100")
def negative_offset(spark, sf_dir):
    return position.skip(events(spark, sf_dir), -100).select("event_id", "pos")


@query("SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM orders) AS m, (SELECT count(*) FROM events) = (SELECT count(*) FROM orders) AS equal")
def strict_length(spark, sf_dir):
    x, y = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    try:
        position.check_equal_length(x, y)
        equal = True
    except ValueError:
        equal = False
    n = x.agg(F.count(F.lit(1)).alias("n"))
    return n.join(y.agg(F.count(F.lit(1)).alias("m")), F.lit(True)).withColumn("equal", F.lit(equal))


@query(f"WITH {ORDERED} SELECT {PART} AS part, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY 1")
def thirds_split(spark, sf_dir):
    rows = position.split_thirds(events(spark, sf_dir, "value"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {ORDERED} SELECT pos, event_id, value FROM ev")
def splits_concat(spark, sf_dir):
    rows = position.split_thirds(events(spark, sf_dir, "value"))
    train, prune, rest = (rows.filter(F.col("part") == p).select("pos", "event_id", "value") for p in position.PARTS)
    return train.unionByName(prune).unionByName(rest)


@query(f"WITH {ORDERED} SELECT pos, event_id, value FROM ev WHERE pos < 5")
def head5(spark, sf_dir):
    return position.head(events(spark, sf_dir, "value")).select("pos", "event_id", "value")


_SCALED = "round((l_{0} - min(l_{0}) OVER ()) / (max(l_{0}) OVER () - min(l_{0}) OVER ()), 9) AS {0}"


@query(f"SELECT l_orderkey, l_linenumber, {_SCALED.format('quantity')}, {_SCALED.format('extendedprice')} FROM lineitem")
def minmax_normalise(spark, sf_dir):
    found = metrics.min_max(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", F.round("l_quantity", 9).alias("quantity"), F.round("l_extendedprice", 9).alias("extendedprice"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice * l_discount)), 4) AS mae, round(avg(pow(l_extendedprice * l_discount, 2)), 2) AS mse
          FROM lineitem GROUP BY 1""")
def mae_mse(spark, sf_dir):
    price = F.col("l_extendedprice")
    found = metrics.errors(table(spark, sf_dir, "lineitem"), price, price * (1 - F.col("l_discount")), ["l_returnflag"])
    return found.select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"))


@query("SELECT l_returnflag, round(1 / avg(abs(l_quantity - 25)), 9) AS fitness FROM lineitem GROUP BY 1")
def fitness(spark, sf_dir):
    return metrics.errors(table(spark, sf_dir, "lineitem"), "l_quantity", F.lit(25.0), ["l_returnflag"]).select("l_returnflag", F.round("fitness", 9).alias("fitness"))


@query("""
    WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem),
    v AS (SELECT unnest([(l_quantity - a) / (b - a), (l_extendedprice - c) / (d - c)]) AS v FROM lineitem, s)
    SELECT round(count(*) * log2(1 + pow(avg(v) / stddev_pop(v), 2)), 3) AS bits FROM v""")
def shannon_hartley(spark, sf_dir):
    return metrics.shannon_hartley(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).select(F.round("bits", 3).alias("bits"))


_BINNED = """binned AS (SELECT *, CASE WHEN k < 49 AND v >= (k + 1) * CAST(0.02 AS DOUBLE) THEN k + 1 WHEN v < k * CAST(0.02 AS DOUBLE) THEN k - 1 ELSE k END AS bin
             FROM (SELECT *, CAST(least(floor(v * 50), 49) AS BIGINT) AS k FROM scaled))"""


@query(f"""
    WITH scaled AS (SELECT (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS v FROM events), {_BINNED}
    SELECT bin, count(*) AS n FROM binned GROUP BY 1""")
def histogram50(spark, sf_dir):
    scaled = metrics.min_max(table(spark, sf_dir, "events").select("value"), ["value"])
    return metrics.histogram(scaled, "value")


def _genome(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each label is a genome whose connections are its vectors' components."""
    vectors = table(spark, sf_dir, "embeddings")
    cells = vectors.select(F.col("label").alias("genome_id"), "vec_id", F.posexplode("embedding").alias("i", "x"))
    connections = cells.select("genome_id", F.concat_ws("-", "vec_id", "i").alias("key"), F.col("x").cast("double").alias("weight"), (F.col("i") % 3 != 0).alias("enabled"))
    return connections, vectors.select(F.col("label").alias("genome_id"), F.col("vec_id").alias("key"))


_CELLS = """cells AS (SELECT label AS genome_id, CAST(embedding[i] AS DOUBLE) AS w, (i - 1) % 3 <> 0 AS enabled
            FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    scaled AS (SELECT genome_id, (w - min(w) OVER g) / (max(w) OVER g - min(w) OVER g) AS v FROM cells WHERE enabled WINDOW g AS (PARTITION BY genome_id))"""
_ENTROPY = f"""{_CELLS}, {_BINNED}, bins AS (SELECT genome_id, bin, count(*) AS c FROM binned GROUP BY 1, 2),
    shares AS (SELECT genome_id, c / sum(c) OVER (PARTITION BY genome_id) AS p FROM bins),
    entropies AS (SELECT genome_id, -sum(p * log2(p)) AS entropy FROM shares GROUP BY 1)"""


@query(f"WITH {_ENTROPY} SELECT genome_id, round(entropy, 8) AS entropy FROM entropies")
def weight_entropy(spark, sf_dir):
    return genome.weight_entropy(_genome(spark, sf_dir)[0]).select("genome_id", F.round("entropy", 8).alias("entropy"))


@query(f"""WITH {_ENTROPY}, counts AS (SELECT genome_id, count(*) AS n_connections FROM cells GROUP BY 1),
    nodes AS (SELECT label AS genome_id, count(*) AS n_nodes FROM embeddings GROUP BY 1)
    SELECT genome_id, n_connections, n_nodes, round(n_connections * entropy, 4) AS total_information
    FROM counts JOIN nodes USING (genome_id) JOIN entropies USING (genome_id)""")
def total_information(spark, sf_dir):
    found = genome.total_information(*_genome(spark, sf_dir))
    return found.select("genome_id", "n_connections", "n_nodes", F.round("total_information", 4).alias("total_information"))


@query()
def kolmogorov_complexity(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), kolmogorov(text).alias("complexity"))


@query(f"""WITH {ORDERED}, held AS (SELECT pos, n, array_agg(value) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM ev)
    SELECT pos AS row_id, w[1] AS a, w[2] AS b, w[3] AS c FROM held WHERE pos <= n - 3""")
def sliding_window(spark, sf_dir):
    w = windows.sliding_window(events(spark, sf_dir, "value"), 3, "value")
    return w.select("row_id", *[F.col("w")[i].alias(c) for i, c in enumerate("abc")])


@query(f"WITH {ORDERED} SELECT pos, round(value, 6) AS output FROM ev")
def overlap_add(spark, sf_dir):
    back = windows.overlap_add(windows.sliding_window(events(spark, sf_dir, "value"), 5, "value"))
    return back.select("pos", F.round("output", 6).alias("output"))


@query(f"""WITH {ORDERED}, held AS (SELECT pos, n - 4 AS n, list(value) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM ev),
    cells AS (SELECT pos + k - 1 AS pos, w[k] AS v, n FROM (SELECT pos, n, w, unnest(range(1, 6)) AS k FROM held WHERE pos < n))
    SELECT pos, round(sum(v) / (CASE WHEN pos < 3 THEN pos + 1 ELSE 1 END * CASE WHEN pos >= 3 AND pos < any_value(n) THEN 5 ELSE 1 END
           * CASE WHEN pos >= any_value(n) THEN any_value(n) + 5 - pos ELSE 1 END), 6) AS output FROM cells GROUP BY pos""")
def overlap_add_compat(spark, sf_dir):
    back = windows.overlap_add(windows.sliding_window(events(spark, sf_dir, "value"), 5, "value"), "compat")
    return back.select("pos", F.round("output", 6).alias("output"))


@query(f"""WITH {ORDERED} SELECT event_id, round(CASE WHEN gap = 0 THEN 'infinity'::DOUBLE ELSE 1 / nullif(gap, 0) END, 4) AS reward, done
    FROM (SELECT event_id, abs(coalesce(lead(value) OVER (ORDER BY pos), value) - (value * 0.9 + 25)) AS gap, pos = n - 1 AS done FROM ev)""")
def series_reward(spark, sf_dir):
    rows = events(spark, sf_dir, "value").withColumn("p", F.col("value") * 0.9 + 25)
    found = windows.step_rewards(rows, "value", "p")
    return found.join(rows.select("pos", "event_id"), "pos").select("event_id", F.round("reward", 4).alias("reward"), "done")


@query(f"""WITH {BY_USER} SELECT user_id, pos, round(CASE WHEN gap = 0 THEN 'infinity'::DOUBLE ELSE 1 / nullif(gap, 0) END, 4) AS reward, done
    FROM (SELECT user_id, pos, abs(coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), value) - value) AS gap, pos + 1 = least(n, 50) AS done FROM ev) WHERE pos < 50""")
def lead_reward(spark, sf_dir):
    rows = events(spark, sf_dir, "value", by=("user_id",)).withColumn("p", F.col("value"))
    found = windows.step_rewards(rows, "value", "p", 50, ["user_id"])
    return found.select("user_id", "pos", F.round("reward", 4).alias("reward"), "done")


@query(f"WITH {ORDERED} SELECT pos, CASE WHEN pos < 6300 THEN value ELSE 0 END AS reward FROM ev WHERE pos <= 6300")
def value_reward(spark, sf_dir):
    return windows.value_rewards(events(spark, sf_dir, "value"), "value", 6300)


@query(f"WITH {BY_USER} SELECT user_id, pos + 1 AS t, least(pos + 1, n - 1) AS idx, pos + 1 = least(50, n) AS done FROM ev WHERE pos < 50")
def episode_clamp(spark, sf_dir):
    return windows.episode(events(spark, sf_dir, by=("user_id",)), 50, ["user_id"])


_RETURN = "sum(value * power(0.99, pos)) OVER ({0}ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / power(0.99, pos)"


@query(f"WITH {BY_USER} SELECT event_id, round({_RETURN.format('PARTITION BY user_id ')}, 4) AS ret FROM ev")
def discounted_return(spark, sf_dir):
    rows = events(spark, sf_dir, "value", by=("user_id",))
    return windows.discounted_return(rows, GAMMA, "value", ["user_id"]).select("event_id", F.round("ret", 4).alias("ret"))


@query(f"WITH {ORDERED} SELECT event_id, round({_RETURN.format('')}, 4) AS ret FROM ev")
def series_return(spark, sf_dir):
    return windows.discounted_return(events(spark, sf_dir, "value"), GAMMA, "value").select("event_id", F.round("ret", 4).alias("ret"))


@query(f"WITH {BY_USER} SELECT event_id, round({_RETURN.format('PARTITION BY user_id ')} - 100 * value, 4) AS advantage FROM ev")
def advantage(spark, sf_dir):
    steps = windows.discounted_return(events(spark, sf_dir, "value", by=("user_id",)), GAMMA, "value", ["user_id"])
    return windows.advantage(steps, F.col("value") * 100).select("event_id", F.round("advantage", 4).alias("advantage"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, pos, turn, role, text FROM t UNION ALL SELECT conv_id, n, turn, role, text FROM t WHERE pos = n - 1 AND n <> 4""")
def trajectory_pad(spark, sf_dir):
    turns = position.with_position(table(spark, sf_dir, "conversations"), "turn", "role", "text", by=("conv_id",), nulls="last")
    return windows.pad(turns, 4, ["conv_id"]).select("conv_id", "pos", "turn", "role", "text")


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a price path: signals by the hour, flat at every third event."""
    rows = events(spark, sf_dir, "value").withColumn("date", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    equity = F.col("value") + 10_000
    path = rows.withColumns({
        "order_status": F.when(F.col("event_id") % 3 == 0, 0).otherwise(1), "close": F.col("value"), "low": F.col("value") - 0.5, "high": F.col("value") + 0.5,
        "equity": equity, "balance": equity - F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(1.0),
    })
    return orders.signals(path, BUYS, SELLS)


_hours = lambda dates: ", ".join(f"TIMESTAMP '{d}'" for d in dates)
_SIGNALS = f"""{ORDERED}, path AS (SELECT *, date_trunc('hour', ts) AS date, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY pos) AS k FROM ev),
    acted AS (SELECT *, CASE WHEN k > 1 THEN 0 WHEN date IN ({_hours(BUYS)}) THEN 1 WHEN date IN ({_hours(SELLS)}) THEN 2 ELSE 0 END AS action FROM path)"""


@query(f"WITH {_SIGNALS} SELECT event_id, action FROM acted")
def date_signal(spark, sf_dir):
    return _market(spark, sf_dir).select("event_id", "action")


@query(f"""WITH {_SIGNALS} SELECT event_id FROM acted WHERE (SELECT count(*) FROM acted WHERE action <> 0) < {len({*BUYS, *SELLS})} OR pos <= (SELECT max(pos) FROM acted WHERE action <> 0)
    + (SELECT max_by(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, pos) FROM acted WHERE action <> 0)""")
def until_last_signal(spark, sf_dir):
    return orders.until_done(_market(spark, sf_dir), len({*BUYS, *SELLS})).select("event_id")


@query(f"""WITH {_SIGNALS}, flat AS (SELECT *, lead(pos) OVER w AS p2, lead(action) OVER w AS a2, lead(value) OVER w AS v2, lead(event_id) OVER w AS e2
        FROM acted WHERE event_id % 3 = 0 WINDOW w AS (ORDER BY pos)),
    o AS (SELECT pos AS opened_at, action, value AS price, (value + 10000) * 0.1 * 100 AS volume, CASE WHEN a2 = 0 THEN p2 END AS closed_at,
        CASE WHEN a2 = 0 THEN (CASE WHEN action = 1 THEN v2 - 0.5 - value ELSE value - (v2 + 0.5 + 0.001) END) / 0.0001 END AS pips,
        CASE WHEN a2 = 0 THEN e2 % 2 = 0 END AS balanced FROM flat WHERE action <> 0)
    SELECT opened_at, action, price, round(volume, 4) AS volume, closed_at, round(pips, 3) AS pips, balanced, round(pips * 0.0001 * volume, 4) AS profit FROM o""")
def order_ledger(spark, sf_dir):
    found = orders.ledger(_market(spark, sf_dir), 0.1, 100)
    rounded = {"volume": F.round("volume", 4), "pips": F.round("pips", 3), "profit": F.round("profit", 4)}
    return found.withColumns(rounded).select("opened_at", "action", "price", "volume", "closed_at", "pips", "balanced", "profit")


@query(f"""WITH {_SIGNALS}, flat AS (SELECT *, lead(action) OVER (ORDER BY pos) AS a2 FROM acted WHERE event_id % 3 = 0)
    SELECT max_by(value + 10000 - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, pos) AS balance, max_by(value + 10000, pos) AS equity,
           (SELECT count(*) FROM flat WHERE action <> 0 AND a2 = 0) AS num_closes FROM acted""")
def rule_account(spark, sf_dir):
    market = materialise(_market(spark, sf_dir), "market")
    return orders.account(market, orders.ledger(market, 0.1, 100))


def _net_sql() -> str:
    unit = lambda w, b, of: f"list_sum(list_transform(range(1, {len(w) + 1}), lambda i: ({w.tolist()})[i] * CAST({of}[i] AS DOUBLE))) + {float(b)}"
    hidden = ", ".join(f"greatest({unit(w, b, 'embedding')}, 0)" for w, b in zip(NET[0].weights, NET[0].bias, strict=True))
    return f"WITH h AS (SELECT vec_id, [{hidden}] AS h FROM embeddings) SELECT vec_id, round(tanh({unit(NET[1].weights[0], NET[1].bias[0], 'h')}), 8) AS prediction FROM h"


@query(_net_sql())
def mlp_forward(spark, sf_dir):
    seen = network.predict(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), NET, "embedding")
    return seen.select("vec_id", F.round(F.col("Prediction")[0], 8).alias("prediction"))


_WIDE = [network.Layer(np.round(WEIGHTS.uniform(-0.5, 0.5, (network.WIDE, 64)), 2), np.zeros(network.WIDE), "relu"), network.Layer(np.full((1, network.WIDE), 0.125), np.zeros(1))]


@query(f"""WITH w AS (SELECT unnest({_WIDE[0].weights.tolist()}) AS w)
    SELECT vec_id, round(0.125 * sum(greatest(list_sum(list_transform(range(1, 65), lambda i: w[i] * CAST(embedding[i] AS DOUBLE))), 0)), 6) AS prediction
    FROM embeddings, w GROUP BY vec_id""")
def mlp_forward_wide(spark, sf_dir):
    seen = network.predict(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _WIDE, "embedding")
    return seen.select("vec_id", F.round(F.col("Prediction")[0], 6).alias("prediction"))


@query("SELECT event_id, round(-0.5 * pow(value / 100 - 2, 2) - 0.5 * ln(2 * pi()), 9) AS logp FROM events")
def gaussian_logprob(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.gaussian_logprob(F.col("value") / 100, F.lit(2.0)), 9).alias("logp"))


@query("""WITH t AS (SELECT exp(-(user_id % 7) / 10.0 + (event_id % 5) / 10.0) AS r, value - 100 AS a FROM events)
    SELECT round(-avg(least(r * a, least(greatest(r, 0.8), 1.2) * a)), 6) AS loss FROM t""")
def ppo_clip(spark, sf_dir):
    term = numeric.clipped_surrogate(-(F.col("user_id") % 7) / 10.0, -(F.col("event_id") % 5) / 10.0, F.col("value") - 100)
    return table(spark, sf_dir, "events").agg(F.round(-F.avg(term), 6).alias("loss"))


@query("""SELECT count(embedding) AS n, CAST(min(len(embedding)) AS BIGINT) AS shortest, CAST(max(len(embedding)) AS BIGINT) AS longest,
          min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings""")
def uniform_lengths(spark, sf_dir):
    return metrics.uniform_length(table(spark, sf_dir, "embeddings"), "embedding")


@query("""SELECT c.n_nationkey AS key, n_name AS value FROM nation c WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r_regionkey = c.n_nationkey AND r_name = c.n_name)""")
def config_diff(spark, sf_dir):
    have = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return options.table_difference(have, known)


@query("SELECT o_orderkey, CAST(epoch_us(o_orderdate) * 1000 AS DOUBLE) AS nanos FROM orders")
def epoch_nanos(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", as_double(F.col("o_orderdate"), rows.schema["o_orderdate"].dataType, epoch=True).alias("nanos"))


def _vector_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a genome; a weight is a whole number of thousandths."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("genome_id"), F.posexplode("embedding").alias("i", "x"))
    weight = F.floor(F.col("x").cast("double") * 1000).cast("double")
    return cells.select("genome_id", F.concat_ws("-", F.lit("c"), "i").alias("key"), weight.alias("weight"), (F.col("i") % 3 != 0).alias("enabled"))


@query("""WITH cells AS (SELECT vec_id, i - 1 AS i, CAST(CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS DOUBLE) AS w
            FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
    SELECT vec_id AS genome_id, CAST(8 * (1 + sum(1 + length('{"key":"c-' || i || '","weight":' || CAST(w AS VARCHAR) || ',"enabled":' || (i % 3 <> 0) || '}'))) AS BIGINT) AS bits
    FROM cells GROUP BY vec_id""")
def genome_serialised(spark, sf_dir):
    return genome.serialised(_vector_genomes(spark, sf_dir)).select("genome_id", "bits")


@query()
def genome_complexity(spark, sf_dir):
    return genome.complexity(_vector_genomes(spark, sf_dir))


@query()
def ppo_training(spark, sf_dir):
    rows = events(spark, sf_dir, "value", "user_id")
    scaled = materialise(rows.select("pos", F.array(F.col("value") / 500, F.col("user_id") % 10 / 10).alias("state"), (F.col("value") / 500).alias("y")), "episode")
    _, losses = training.train(scaled, 2, 2, training.PpoParams(hidden=8))
    return spark.createDataFrame(list(enumerate(losses)), "step long, loss double")


@query("""WITH seen AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS v2 FROM events)
    SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS seq, CASE WHEN v2 = value THEN 'infinity'::DOUBLE ELSE 1 / abs(v2 - value) END AS reward
    FROM seen WHERE v2 IS NOT NULL""")
def stream_rewards(spark, sf_dir):
    """Of a user's events at the same time, between which the SQL leaves the order open, the least event_id comes first."""
    folder = f"{shared_root(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file or a folder of files
    rows = stream.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("value").alias("actual"), F.col("value").alias("predicted"), "event_id")
    sink = rewards.step_rewards(rows, ties=["event_id"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rewards.RESULT).parquet(f"{folder}/out")
